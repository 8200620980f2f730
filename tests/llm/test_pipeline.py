"""The corpus pipeline, stage by stage and as a whole, and operators on very long, empty and clashing input, against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from rasterlake import attach
from rasterlake.llm import chat, components, fertility, gam, mixing, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def find(x, p):
    while p[x] != x:
        x = p[x]
    return x


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two qualities with copies, a shared passage, nulls, empty texts and repeated rows, and their labels."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    passage = rng.choices(vocab, k=70)
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 3
        words = rng.choices(vocab, k=rng.randint(60, 160)) if good else rng.choices(["!!!", "$$$", "123", "|"], k=rng.randint(60, 160))
        if good and i % 10 == 1:
            words[20:20] = passage
        if good and i % 10 == 2 and i > 20:
            words = rows[i - 20][1].split() if rows[i - 20][1] else words
            words = [*words[:-1], "edit"]
        rows.append((i, " ".join(words), ["en", None, "fr"][i % 3], ["a", "a", "b", None][i % 4 if i % 4 != 3 else 0], 5))
        labels.append((i, int(good), 0))
    rows += [(300, None, None, None, None), (301, "", "en", "b", 0), (302, " \n", "xx", "", 2), rows[0], rows[0], (303, "x " * 30_000, "en", "a", 60_000)]
    d = str(tmp_path_factory.mktemp("sf"))
    s = attach(spark)
    s.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    s.createDataFrame([*labels, (0, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def keyed(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["predicted"] for r in gam.classify(docs, labels).collect()}
    kept = stage["quality classifier"](spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    want = Counter({k: n for k, n in keyed(docs).items() if scores[k[0]]})
    got = keyed(kept)
    assert got == want and {i for i, _ in got} >= {i for i in range(240) if i % 4 != 3} and not {i for i, _ in got} & {i for i in range(240) if i % 4 == 3}

    texts = dict(got)
    ids = sorted(i for i, _ in texts)
    text = dict(texts.keys())
    sets = {}
    for i in ids:
        w = WORD.findall((text[i] or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    p = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i, p), find(j, p)
                p[max(a, b)] = min(a, b)
    single = stage["n-gram Jaccard join"](spark, kept, folder)
    got = keyed(single)
    assert got == Counter({k: n for k, n in texts.items() if find(k[0], p) == k[0]}) and len(got) < len(texts)

    seen, left = set(), {}
    for i, t in sorted(got):
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        gone = {k for j, x in enumerate(windows) if x in seen for k in range(j, j + 50)}
        seen.update(windows)
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    cut = stage["substring dedup"](spark, single, folder)
    rows = cut.collect()
    assert {r["doc_id"]: WORD.findall(r["text"] or "") for r in rows} == left and len(rows) == single.count()
    assert any(len(left[i]) < len(WORD.findall(t or "")) for i, t in got)

    mixed = stage["mixing sources"](spark, cut, folder)
    often = keyed(mixed)
    before = keyed(cut)
    assert set(often) == set(before) and all(before[k] <= n <= 3 * before[k] for k, n in often.items()) and sum(often.values()) > sum(before.values())

    packed = stage["packing"](spark, mixed, folder).toPandas()
    assert set(packed.doc_id) == {i for i, _ in often} and packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    ids = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert 0 in ids and not ids & {i for i in range(240) if i % 4 == 3}


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert not stage(spark, docs, folder).count()


def test_additive_scores_by_hand():
    """A model's score is the logistic of its tables' entries, read bin by bin."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400) > 0).astype(float)
    m = gam.train(x, y, rounds=30)
    assert m.pairs
    for row, got in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.prior + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, m.edges, m.tables, strict=True))
        z += sum(t[sum(row[a] >= e for e in m.coarse[a]), sum(row[b] >= e for e in m.coarse[b])] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-z)))
    assert np.mean((m.score(x) > 0.5) == (y == 1)) > 0.9 and np.mean((gam.train(x, y, rounds=30, pairs=0).score(x) > 0.5) == (y == 1)) < np.mean((m.score(x) > 0.5) == (y == 1))


def test_cut_by_hand():
    """The best cut of a run of bins against all cuts."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.uniform(1.1, 3, 9)
        gains = [g[:k].sum() ** 2 / (h[:k].sum() + 2) + g[k:].sum() ** 2 / (h[k:].sum() + 2) - g.sum() ** 2 / (h.sum() + 2) for k in range(1, 9)]
        gain, at = gam._best_cut(g, h, 2.0)
        assert gain == pytest.approx(max(gains)) and at == 1 + int(np.argmax(gains))


def test_fertility_measures_by_hand(spark):
    """Tokens, bytes, entropy and the verdict of whole texts, word by word, with the tokenizer alone."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    words = ["the", "house", "größe", "año", "x1y2z3", "日本語", "zzzzqqqq", "on", "of", "water", "🙂", "été"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (60, 200, 80, 51)] + [" ".join(f"w{rng.random()}" for _ in range(70)), " ".join(["日本", "中文", "漢字", "語彙"][i % 4] + str(i) for i in range(60)), None, "", "one two", "many words " * 20_000]
    rows = [(i, t, [None, "en", "de", "xx"][i % 4], "clash", 1) for i, t in enumerate(texts)]
    rules = fertility.Rules(path)
    df = attach(spark).createDataFrame(rows, "doc_id long, text string, lang string, t string, l int")
    verdicts = set()
    for r in fertility.judge(df, rules).collect():
        w = WORD.findall(texts[r["doc_id"]] or "")
        ids = [t for x in w for t in sp.encode(x)]
        c = Counter(ids)
        entropy = -sum(n / len(ids) * np.log2(n / len(ids)) for n in c.values()) if ids else 0.0
        chars = sum(map(len, w))
        per, share = chars / max(len(ids), 1), sum(sp.is_byte(t) for t in ids) / max(len(ids), 1)
        assert (r["n_tokens"], r["chars_per_token"], r["byte_share"]) == (len(ids), pytest.approx(per), pytest.approx(share)) and r["token_entropy"] == pytest.approx(entropy, abs=1e-9)
        latin = sum(ord(x) < 0x380 for y in w for x in y)
        lang = rows[r["doc_id"]][2]
        band = rules.bands.get(lang) or rules.bands["latin" if 2 * latin >= chars else "other"]
        assert r["kept"] == (not r["base_failed"] and band.min_chars <= per <= band.max_chars and entropy >= band.min_entropy and share <= band.max_bytes)
        verdicts.add((r["base_failed"], r["kept"]))
    assert verdicts >= {(True, False), (False, True), (False, False)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    p = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None:
            x, y = find(a, p), find(b, p)
            p[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x, p) for x in p if find(x, p) != x}
    assert not components.connected_components(spark.createDataFrame([], "a long, b long")).count()
    with pytest.raises(RuntimeError):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long"), rounds=1)


def test_chat_of_many_turns_and_clashing_columns(spark):
    turns = [(1, i, "user" if i % 2 else "bot", f"t{i}", 0, "p", "h") for i in range(700)]
    turns += [(2, *t[1:]) for t in turns[:300]] + [(3, *t[1:]) for t in turns[:256]] + [(4, *t[1:3], "other", *t[4:]) for t in turns[:300]] + [(5, 0, "user", "long " * 100_000, 0, "", "")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, position long, span string, h1 string").repartition(4)).collect()}
    assert got == {1: 700, 4: 300, 5: 1}


def test_urls_of_empty_tables_odd_labels_and_literal_marks(spark):
    pages = [(i, f"http://h.io/{'<num>' if i % 2 else i}/x", "clash", 1) for i in range(120)] + [(500, "http://h.io/" + "a/" * 3000, "", 0)]
    df = attach(spark).createDataFrame(pages, "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([(i, [0, 1, 7, None][i % 4]) for i in range(120)], "page_id long, good int")
    got = {r["page_id"]: r["template"] for r in urls.judge(df, labels, []).collect()}
    assert len(got) == len(pages) and got[1] != got[2] == "/<num>/x"
    assert not urls.judge(df.limit(0), labels, []).count() and urls.judge(df, labels.limit(0), []).count() == len(pages)


def test_mixing_ties_and_clashing_columns(spark):
    rows = [(i % 3, "a b c", ["x", "y"][i % 2], i, "t") for i in range(12)] + [(9, "word " * 50_000, "x", 1, "")]
    df = attach(spark).createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, src string")
    got = mixing.mix(df, mixing.Target(max_repeat=2.0)).toPandas()
    assert Counter(got[got["pass"] == 0].doc_id) == Counter(r[0] for r in rows)


def test_few_keys_are_met_without_a_second_python_step(spark, monkeypatch):
    """A step after hits() is the only one with Python workers; a bitmap, for more keys, finds the same rows."""
    from rasterlake.llm import runtime

    rows = attach(spark).createDataFrame([(i if i % 7 else None, i % 3, f"t{i}") for i in range(60)], "doc_id long, k int, t string")
    wanted = rows.filter("doc_id % 2 = 0").select("doc_id").distinct()
    few = [runtime.hits(rows, wanted, ["doc_id"], 30, keep) for keep in (False, True)]
    for df in few:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "BroadcastHashJoin" in plan and df.columns == rows.columns
    monkeypatch.setattr(runtime, "KEYS", 0)
    many = [runtime.hits(rows, wanted, ["doc_id"], 30, keep) for keep in (False, True)]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["t"])
    got, want = ([sorted((r for r in df.collect() if r["doc_id"] is not None), key=key) for df in pair] for pair in (few, many))
    assert got == want
    assert sorted(r["t"] for df in few for r in df.collect()) == sorted(r["t"] for r in rows.collect())


def test_pipeline_keeps_batches_small_unless_told_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    corpus_pipeline.ready(session)
    assert session.conf.get(name) == corpus_pipeline.BATCH
    session.conf.set(name, "8m")
    corpus_pipeline.ready(session)
    assert session.conf.get(name) == "8m"
