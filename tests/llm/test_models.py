"""Learned operators: language, quality, secrets."""

import hashlib
import re

import numpy as np
import pytest

from evenkeel.llm import language, quality, queries, secrets
from tests.llm.helpers import documents, edge_texts


@pytest.fixture(scope="module")
def docs(spark, folder):
    from evenkeel.llm.common import table

    return table(spark, folder.replace("sf0.001", "sf0.01"), "documents")


def test_language_filter_has_no_false_negative():
    rows = np.zeros(language.ROWS, np.uint8)
    codes = np.arange(5000, dtype=np.uint32) * np.uint32(7919)
    for seed in language._SEEDS:
        rows[language._rows_of(codes, seed)] |= 4
    assert (language.lookup(rows, codes) & 4 == 4).all()


def test_grams_stay_within_texts():
    codes, sizes = language.grams(["abc", "", "x1yz abcd"])
    alone = [language.grams([t]) for t in ("abc", "", "x1yz abcd")]
    assert sizes.tolist() == [int(s[0]) for _, s in alone]
    assert codes.tolist() == [c for a, _ in alone for c in a.tolist()]


def test_language_held_out_accuracy_and_edges(spark, docs):
    held = "coalesce(crc32(string(doc_id)) % 5 = 0, false)"
    model = language.fit(docs.where(f"NOT {held}"))
    rows = language.identify(docs.where(f"{held} AND length(text) > 100"), model, ["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    edge = language.identify(documents(spark, edge_texts()), model, ["text", "key"]).collect()
    for r in edge:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in model.languages) == letters and (letters or r.lang_pred == "und") and 0 <= r.score <= 1
    nothing = language.fit(documents(spark, []))
    assert {r.lang_pred for r in language.identify(documents(spark, ["a", None]), nothing, []).collect()} == {"und"}


def test_every_one_of_many_languages_is_learned(spark):
    rng = np.random.default_rng(3)
    names = [f"l{i:03d}" for i in range(150)]
    words = {x: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for x in names}
    made = [(x, " ".join(rng.choice(words[x], 30))) for i, x in enumerate(names) for _ in range(6 if i < 75 else 4)]
    docs = documents(spark, [(i, t, x, "s", len(t)) for i, (x, t) in enumerate(made)])
    model = language.fit(docs)
    assert model.languages == names and model.rows.shape == (3, language.ROWS)
    rows = language.identify(docs, model, ["lang"]).collect()
    assert len(rows) == 750 and all(r.lang == r.lang_pred and r.score > 0.5 for r in rows)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(9, quality.FEATURES)), np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    shapes = {"W": (quality.FEATURES, 32), "b": (32,), "V": (32, 16), "U": (32, 16), "a": (16,), "o": (32,), "c": (1,)}
    w = {k: rng.normal(size=s) * 0.1 for k, s in shapes.items()}

    def loss(v):
        p = quality._forward(v, x, counts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradients(w, x, counts, y)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][at]) < 1e-6


def test_passages_are_independent_of_the_batch():
    texts = [t or "" for t in edge_texts()[:12]]
    together, counts = quality.passages(texts)
    apart = np.concatenate([quality.passages([t])[0] for t in texts])
    assert counts.min() == 1 and np.allclose(together, apart, atol=1e-6)


def test_quality_held_out(spark, docs, folder):
    from evenkeel.llm.common import table

    labels = table(spark, folder.replace("sf0.001", "sf0.01"), "labels")
    model = quality.fit(docs, labels)
    held = docs.join(labels, "doc_id").where("crc32(string(doc_id)) % 3 = 1")
    rows = quality.with_score(held, model).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    edge = quality.with_score(documents(spark, edge_texts()).drop("score"), model).collect()
    assert len(edge) == len(edge_texts()) and all(0 <= r.score <= 1 for r in edge)
    unlabelled = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.with_score(documents(spark, ["a", None]), unlabelled).collect()} == {0.5}


def expected_secrets(text):
    pattern = r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(1)) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(s for *_, s in sorted(out))


def test_secret_rules(spark, docs):
    texts = ["é password=abcdef", "token: token: abcdefgh", "API_KEY = 'x.y-z_1='", "paſſword=abcdefg", "AKIA" + "B" * 16 + "AKIA" + "C" * 20,
             "AKIAAKIA" + "0" * 9, "f" * 24 + "g" + "a" * 23, "secret=short secret=" + "0" * 30, *edge_texts()[:14]]
    rows = {r.doc_id: r for r in secrets.secrets_digest(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert rows[i].base_sha256 == hashlib.sha256(expected_secrets(text or "").encode()).hexdigest(), text
    assert secrets.secrets_digest(documents(spark, [])).collect() == []


def test_secret_network():
    rng = np.random.default_rng(5)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = ["".join(rng.choice(alphabet, 28)) for _ in range(300)]
    paths = ["/".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4)) + "/file1" for _ in range(300)]
    windows = np.stack([secrets.window(f"see {v} here", 4, 4 + len(v)) for v in keys + paths])
    labels = np.repeat([1, 0], 300)
    held = np.arange(600) % 4 == 0
    net = secrets.train(windows, labels, held)
    p = net.probability(windows)
    assert (p[labels == 1] >= net.threshold[0]).mean() > 0.9 and (p[labels == 0] >= net.threshold[0]).mean() < 0.05
    text = f"cfg {keys[0]} end"
    assert [(a, b, k) for a, b, k, _ in secrets.scan([text], net)[0]] == [(4, 32, "cnn")]
    assert secrets.train(windows[:4], labels[:4], held[:4]) is None


def test_secret_threshold_keeps_the_recall_where_classes_overlap():
    rng = np.random.default_rng(6)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = ["".join(rng.choice(alphabet, 28)) for _ in range(500)]
    paths = ["/".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4)) + "/file1" for _ in range(500)]
    windows = np.stack([secrets.window(f"see {v} here", 4, 4 + len(v)) for v in keys + paths])
    labels = np.repeat([1, 0], 500)
    labels[500:700] = 1  # findings that look like the other candidates
    held = np.arange(1000) % 4 == 0
    net = secrets.train(windows, labels, held)
    p = net.probability(windows)
    assert net.recall[0] == (p[held & (labels == 1)] >= net.threshold[0]).mean() >= secrets.RECALL
    assert net.precision[0] == (labels[held & (p >= net.threshold[0])] == 1).mean() < 0.9


def test_secret_candidates_start_at_the_length_of_assigned_values():
    assert secrets.candidates("see aB3dE9 and aB3dE or Secret words QWERTY") == [(4, 10)]
    assert secrets.candidates("pass: qwertyuio, key='ABCDEF' then: word") == [(6, 15), (22, 28)]
    weights = {"E": np.zeros((secrets.SYMBOLS, secrets.EMBED)), "F": np.zeros((secrets.KERNEL * secrets.EMBED, secrets.FILTERS)),
               "f": np.zeros(secrets.FILTERS), "o": np.zeros(2 * secrets.FILTERS), "c": np.zeros(1)}
    sees_all = secrets.Network(weights)
    assert secrets.scan(["use aB3dE9xY now"], sees_all) == [[(4, 12, "cnn", 0.5)]]


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def made_up(rng, n):
    """Values in forms that no rule finds without a keyword."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = [(letters, 16), (letters, 24), (letters + "+/", 32), (letters + "-_", 40), ("0123456789abcdef", 20), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (letters, 90)]
    return ["".join(rng.choice(list(a), k)) for a, k in (forms[i % len(forms)] for i in range(n))]


def test_secrets_without_a_keyword(spark):
    """Of made-up values between words, or behind a name that is no keyword, nine in ten are found, whole texts else are left alone."""
    from evenkeel.llm.common import table

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    net = secrets.fit(docs)
    assert min(net.recall) >= 0.95 and min(net.precision) >= 0.9
    texts = [r.text for r in docs.select("text").collect() if r.text]
    rng = np.random.default_rng(17)
    values = made_up(rng, 210)
    for before in ("", 'setting = "'):
        found = 0
        for i, value in enumerate(values):
            words = texts[i].split(" ")
            at = int(rng.integers(len(words)))
            text = " ".join(words[:at]) + " " + before + value + " " + " ".join(words[at:])
            start = text.index(value)
            found += any(a <= start and b >= start + len(value) for a, b, *_ in secrets.scan([text], net)[0])
        assert found >= 0.9 * len(values), before
    spans = [s for spans in secrets.scan(texts, net) for s in spans]
    assert sum(s[2] == "cnn" for s in spans) <= 0.02 * sum(s[2] == "assign" for s in spans)
    harmless = "Version v1-2-3 of 2024-05-17, iPhone15 users 12345678 in some_file_name2 or someCamelCase, see a/path/to/file3"
    assert not secrets.scan([harmless], net)[0]


def test_whole_candidates_are_seen():
    text = "x" * 10 + " " + "Ab9" * 50 + " end"
    start, end = secrets.candidates(text)[0]
    pieces = secrets.windows(text, start, end)
    assert len(pieces) == -(-(end - start) // secrets.INSIDE)
    shown = sum(int((p[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] > 0).sum()) for p in pieces)
    assert shown == end - start


def test_few_findings_give_no_network(spark):
    assert secrets.fit(documents(spark, ["token = abcdef1234567890 and some words"] * 30)) is None
    assert secrets.fit(documents(spark, [])) is None


def documents_with_findings(spark, n, partitions=3):
    rng = np.random.default_rng(23)
    values = made_up(rng, n)
    return documents(spark, [f"the words around are {i} and someName{i} is set, password={v} ends it" for i, v in enumerate(values)], partitions)


def test_all_findings_teach_and_set_the_thresholds(spark):
    """More findings than any sample of them had; recall and precision hold over all that are kept back."""
    docs = documents_with_findings(spark, 700)
    net = secrets.fit(docs)
    whole = {(k, y, c, how, w.tobytes()) for r in docs.select("text").collect() for k, y, c, how, w in secrets.examples(r.text)}
    kept = [e for e in whole if (e[0] >> 1) % 4 == 0 and (e[3] > 0 or e[1] == 0)]
    labels, context = (np.array([e[i] for e in kept]) for i in (1, 2))
    p = net.probability(np.stack([np.frombuffer(e[4], np.int64) for e in kept]))
    assert sum(e[1] == 1 and e[2] == 0 for e in whole) > 4000
    for c in (0, 1):
        over = (context == c) & (p >= net.threshold[c])
        assert net.recall[c] == over[labels == 1].sum() / ((context == c) & (labels == 1)).sum() >= secrets.RECALL
        assert net.precision[c] == (labels[over] == 1).mean()


def test_a_fit_in_blocks_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 1000)
    one, other = (secrets.fit(documents_with_findings(spark, 300, partitions)) for partitions in (2, 7))
    assert all((one.weights[k] == other.weights[k]).all() for k in one.weights)
    assert (one.slope, one.shift, one.threshold) == (other.slope, other.shift, other.threshold)
    assert min(one.precision) > 0.8


def test_a_round_is_the_mean_of_all_blocks(spark):
    rng = np.random.default_rng(4)
    shown = rng.integers(0, secrets.SYMBOLS, (300, secrets.WIDTH)).astype(np.uint8)
    rows = [(i, i % 2, bytearray(w.tobytes()), i % 3) for i, w in enumerate(shown)]
    df = spark.createDataFrame(rows, "hash bigint, label int, shown binary, block bigint")
    begin = secrets._begin(11)
    found = secrets._round(df, begin, 0, 5, 2)
    each = [secrets._passes(begin, 0, shown[b::3].astype(np.int64), np.arange(b, 300, 3) % 2, 5, 2) for b in range(3)]
    np.testing.assert_allclose(found, np.mean(each, axis=0, dtype=np.float64), atol=1e-6)
    assert np.abs(found[0] - begin[0]).max() > 0.01


def test_candidates_and_rules_agree_with_plain_expressions(monkeypatch):
    monkeypatch.setattr(secrets, "PART", 7)
    rng = np.random.default_rng(8)
    parts = ["PassWord", "token", "secret", "api_key", "paſſword", *'abzABZ09+/_=-:"\' .é\n\U0001f600', "aB3dE9", "words", "0f" * 12, " = "]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 25))))
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text):
            run = m.group()
            valued = re.search("[A-Za-z]", run) and re.search("[0-9]", run) or re.search("[A-Z]", run[1:]) and re.search("[a-z]", run)
            if valued or re.search(r"""[:=]\x20*["']?\Z""", text[max(0, m.start() - 4) : m.start()]):
                expected.append(m.span())
        assert secrets.candidates(text) == expected, text
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in secrets.base_spans(text)) == expected_secrets(text)
