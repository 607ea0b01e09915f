"""The pipeline, stage by stage, against plain versions on what each stage was given."""

import re

import corpus_pipeline
from evenkeel.llm.common import table
from tests.llm.helpers import documents, prose


def test_stages(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    columns, given = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) == 4

    quality = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    good = [d for d in given if quality.get(d) == 1]
    assert sum(d in kept["quality"] for d in good) >= 0.95 * len(good)
    assert sum(d in kept["quality"] for d in given if quality.get(d) == 0) <= 0.2 * max(1, sum(v == 0 for v in quality.values()))

    seen, first = set(), set()
    for d, text in sorted(kept["quality"].items()):
        normal = re.sub("[\x20\x09-\x0d]+", " ", text or "")
        first |= {d} if normal not in seen else set()
        seen.add(normal)
    assert set(kept["exact dedup"]) == first

    assert set(kept["near dedup"]) <= first
    items = [" ".join(r.text.split()) for r in table(spark, folder, "benchmark").collect()]
    leaking = {d for d, t in kept["near dedup"].items() if any(i in " ".join(t.split()) for i in items)}
    assert set(kept["near dedup"]) - set(kept["decontamination"]) == leaking

    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in tokens} == set(kept["decontamination"])
    assert all(len(r.ids) == r.n_tokens for r in tokens)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each(rows):
    """All pairs: the ids that have no smaller id in their component of links from 80 % of 5-word shingles on."""
    root = {d: d for d, _ in rows}
    sets = [(d, shingles(t)) for d, t in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 5 * len(x & y) >= 4 * len(x | y) and x:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d for d in root if find(d) == d}


def test_near_dedup_is_by_five_words_and_80_percent(spark, folder):
    words = prose(1, 200).split()
    texts = [" ".join(words)]
    for n in range(0, 9):  # 196 shingles, 5 of which hold a changed word: 0.8 falls between 4 and 5 changes
        texts.append(" ".join(w[::-1] if i in range(10, 10 + 20 * n, 20) else w for i, w in enumerate(prose(50 + n, 200).split())))
        texts.append(prose(50 + n, 200))
    long_column = prose(2, 120)  # more documents than a column emits pairs for
    texts += [f"{long_column} {prose(300 + i, 18)}" for i in range(90)] + [f"{prose(7, 3 + i)}" for i in range(6)] + ["", None]
    docs = documents(spark, texts)
    real = table(spark, folder, "documents")
    for given in (docs, real):
        rows = [(r.doc_id, r.text) for r in given.collect()]
        kept = corpus_pipeline.without_near_copies(spark, given, folder).collect()
        assert {r.doc_id for r in kept} == first_of_each(rows)


def folder_of(spark, path, docs, labels, benchmark):
    """A folder of the tables that the pipeline reads."""
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


LABELS, BENCHMARK = "doc_id bigint, quality int, toxic int", "item_id bigint, text string"


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], BENCHMARK)
    path = folder_of(spark, tmp_path, documents(spark, []), *empty)
    assert corpus_pipeline.run(spark, path).collect() == []


def test_rows_without_id_and_columns_with_clashing_names(spark, tmp_path):
    """No quality is labelled, so all documents pass that stage; the others see null ids, repeats and every column."""
    item, a, b = prose(900, 40), prose(1, 60), prose(2, 60)
    rows = [
        (None, a, "x", None, None), (None, a, "x", None, None), (7, a + " ", "x", None, None), (None, b, None, None, None), (None, b + " end", None, None, None),
        (None, f"{prose(3, 50)} {item}", "x", None, None), (9, prose(4, 50), "x", None, None), (9, prose(5, 50), "x", None, None), (None, None, None, None, None), (4, "", "x", None, None),
    ]
    docs = documents(spark, rows).selectExpr("*", "1 AS quality_score", "'m' AS sha", "2 AS doc", "3 AS text_hash", "4 AS suspect", "5 AS _some", "6 AS some")
    path = folder_of(spark, tmp_path, docs, spark.createDataFrame([], LABELS), spark.createDataFrame([(0, item)], BENCHMARK))
    docs = table(spark, path, "documents")
    columns, texts = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        assert docs.columns == columns
        assert all((r.quality_score, r.sha, r.doc, r.text_hash) == (1, "m", 2, 3) for r in docs.collect())
        texts.append(sorted((r.text or "").strip() for r in docs.collect()))
    assert texts[0] == sorted((t or "").strip() for _, t, *_ in rows)
    leak = f"{prose(3, 50)} {item}"
    assert texts[1] == sorted(["", a, a, b, b + " end", leak, prose(4, 50), prose(5, 50)])  # a stays with and without a space
    near = [t for t in texts[2] if t.startswith(b)]
    assert len(near) == 1 and texts[2] == sorted(["", a, near[0], leak, prose(4, 50), prose(5, 50)])
    assert texts[3] == [t for t in texts[2] if t != leak]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert tokens.count() == 5
