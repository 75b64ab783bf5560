"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import additive_ann, bpe, chat, fm_decontaminate, gbt_quality, license_scan, parity_join, rlz_dedup, sharding, toxicity
from timberline.llm.common import lower_words
from timberline.llm.components import components, forest

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 7))) for _ in range(3000)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def corpus():
    base = words(200, 1)
    passage = words(70, 2)
    near = list(base)
    near[100] = "EDIT"
    far = list(base)
    for i in range(0, 200, 12):
        far[i] = "X"
    texts = [
        " ".join(base), " ".join(base), " ".join(near), " ".join(far), None, "", " \n\t ", "one", "one two three", "One two  three",
        " ".join(words(80, 3) + passage + words(90, 4)), " ".join(words(60, 5) + passage + words(10, 6)), " ".join(passage[:49]), " ".join(passage[:50]),
        " ".join(words(6000, 7)), " ".join(["spam"] * 400), " ".join(["spam"] * 300), "x " * 49, "x " * 50, "é" * 20 + " ü ß", " ".join(base[50:150]),
    ]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "s", 0), (None, texts[0], None, None, None), (2, "same id other text", "en", "s", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rlz_dedup(docs, none):
    last = 1 << 63
    rows = [(last if i is None else i, i, (t or "").encode().split()) for i, t, *_ in corpus()]
    first = {}
    for k, _, w in rows:
        for s in range(len(w) - 49):
            win = tuple(w[s : s + 50])
            first[win] = min(first.get(win, last), k)
    want = []
    for k, i, w in rows:
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < k:
                gone.update(range(s, s + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in rlz_dedup.digest(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = rlz_dedup.dedup(docs.withColumn("spans", F.lit(1)))
    assert cut.columns == [*docs.columns, "spans"] and cut.count() == docs.count()
    assert rlz_dedup.digest(none).count() == 0 and rlz_dedup.dedup(none).count() == 0


def test_rlz_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(rlz_dedup, "HOT", 3)
    passage = words(60, 20)
    d = spark.createDataFrame([(i, " ".join(words(55, 100 + i) + passage + words(55, 200 + i))) for i in range(12)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in rlz_dedup.digest(d).collect()}
    assert got == {0: 0, **{i: 60 for i in range(1, 12)}}


def test_rlz_repeats_inside(spark, monkeypatch):
    line, other, edge = words(13, 31), words(20, 32), words(30, 33)
    texts = [edge + line * 40, words(60, 34) + line * 300, line * 25 + edge + line * 9, other * 50 + words(5, 35), words(9, 36) + other * 70 + line * 30, edge + line * 40, ["x", "y"] * 90, ["x", "y"] * 500 + edge]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    rows = rlz_dedup.contexts(d).groupBy("k", "anchor", "context").count()
    assert rows.where("count > 1").count() == 0 and rows.count() < 400  # not one for each place
    first, want = {}, {}
    for i, t in enumerate(texts):
        gone = set()
        for s in range(len(t) - 49):
            if first.setdefault(tuple(t[s : s + 50]), i) < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for j, x in enumerate(t) if j not in gone)
        want[i] = (len(gone), hashlib.sha256(kept.encode()).hexdigest())
    for hot in (rlz_dedup.HOT, 1):
        monkeypatch.setattr(rlz_dedup, "HOT", hot)
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in rlz_dedup.digest(d).collect()} == want
        spans = {r["k"]: rlz_dedup.merged(r["spans"]) for r in rlz_dedup.duplicate_spans(d).collect()}
        assert all(sum(b - a for a, b in spans.get(i, [])) == n for i, (n, _) in want.items())


def test_rlz_steps_apart(docs):
    plan = rlz_dedup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def sets():
    out = []
    for i, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_parity_join(docs, none):
    s = sets()
    parent = list(range(len(s)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= 75 * len(s[a][1] | s[b][1]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, own) in enumerate(s):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    want = sorted(((i, len(own), least.get(root(x)) if own else i) for x, (i, own) in enumerate(s)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.link(docs, 3).collect()), key=str)
    assert got == want
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)[:1] == [0]
    assert parity_join.link(none).count() == 0


def test_parity_join_chain(spark, monkeypatch):
    """Near copies of near copies, more of them than a hot lane has: all one component, whatever meets whom."""
    monkeypatch.setattr(parity_join, "HOT", 4)
    base, rows = words(120, 30), []
    for i in range(25):
        base = list(base)
        base[(7 * i) % 120] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    got = parity_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {76}


def star_family():
    """A base and near copies that link with it but not with each other: rows (doc_id, text), the base first."""
    base, r, rows = words(200, 40), random.Random(41), []
    for i in range(220):
        near = list(base)
        for at in r.sample(range(5, 195, 5), 5):
            near[at] = f"own{i}"
        rows.append((1000 - i, " ".join(near)))
    return [(2000, " ".join(base)), *rows]


def linked_with(rows):
    """How many others each text links with, by brute force; no two texts are alike."""
    s = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    return {i: sum(x is not y and 100 * len(x & y) >= 75 * len(x | y) for y in s) for (i, _), x in zip(rows, s, strict=True)}


@pytest.mark.parametrize("block", [7, 256])
def test_parity_join_counts_all_links(spark, monkeypatch, block):
    """Three families: of two, where all link with all, and where all link with one only."""
    monkeypatch.setattr(parity_join, "BLOCK", block)
    base, rows = words(120, 60), star_family()[:60]
    for i in range(40):
        rows.append((i, " ".join([*base[: 3 * i], f"own{i}", *base[3 * i + 1 :]])))
    pair = words(90, 61)
    rows += [(100, " ".join(pair)), (101, " ".join([*pair, "more"])), (102, " ".join(words(50, 62)))]
    got = {r["doc_id"]: r["n_links"] for r in parity_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    want = linked_with(rows)
    assert got == want and want[2000] == 59 and want[0] == 39 and want[100] == 1 and want[102] == 0


def test_common_shingles_in_narrow_ranges():
    r = np.random.default_rng(3)
    x, y = ([np.unique(r.integers(0, 90, n).astype(np.uint64)) for n in r.integers(1, 60, 9)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert parity_join.common_shingles(x, y, cells=63).tolist() == want


def test_parity_join_hot_lane_is_one_group(spark):
    """A hot lane's members in one partition and a few in another are one group, and a star stays one component."""
    rows, lanes = star_family(), {}
    for s in parity_join.shingle_sets([t for _, t in rows]):
        for lane in parity_join.published(s).tolist():
            lanes.setdefault(lane, set()).add(parity_join.class_of(s)[0])
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows[:201], rows[201:]], 2).flatMap(lambda part: part), "doc_id long, text string")
    groups = [set(r["m"]) for r in parity_join.meetings(docs, 2).where("kind = 'hot'").groupBy("a").agg(F.collect_set("b").alias("m")).collect()]
    hot = [who for who in lanes.values() if len(who) > parity_join.HOT]
    assert len(hot) > 50 and all(any(who <= g for g in groups) for who in hot)
    assert {r["component_id"] for r in parity_join.link(docs, 2).collect()} == {781}


def test_parity_join_larger_of_two_with_hot_lanes_only(spark):
    """Sets of 120 and 160 are sure of 5 lanes; if those are hot, both have to be looked at. With 4, the larger need not."""
    sizes = spark.createDataFrame([(1, 120), (2, 160), (3, 160)], "c1 long, n long")
    hot = spark.createDataFrame([(g, c) for c, lanes in ((1, 5), (2, 5), (3, 4)) for g in range(lanes)], "gid long, c1 long")
    assert {r["c1"] for r in parity_join.hot_only(hot, sizes).collect()} == {1, 2}


def test_parity_join_compares_overlapping_groups_once(spark, monkeypatch, tmp_path):
    """Near copies of one text share very many lanes; members of these groups come to be compared once, not once a lane."""
    r, seen, real = random.Random(13), str(tmp_path), parity_join._between

    def counted(n, *rest):
        import os
        import tempfile

        with os.fdopen(tempfile.mkstemp(prefix=f"{len(n)}-", dir=seen)[0], "w"):
            return real(n, *rest)

    monkeypatch.setattr(parity_join, "_between", counted)
    alike = [parity_join.bit_sketch(np.random.default_rng(i).integers(0, 1 << 63, 400, dtype=np.uint64)) for i in range(4)]
    groups = [r.sample(range(200), 100) for _ in range(60)] + [list(range(5000 + 99 * g, 5100 + 99 * g)) for g in range(4)]  # two nets
    member = spark.createDataFrame([(g, c, 400, alike[c // 50 % 4], c) for g, own in enumerate(groups) for c in own], "gid long, c1 long, n long, sketch binary, family long")
    got = [(e["u"], e["v"]) for e in parity_join.between_families(member).collect()]
    want = [(a, b) for own in groups for a in own for b in own if a < b and a // 50 % 4 == b // 50 % 4]
    assert forest(*zip(*got, strict=True)) == forest(*zip(*want, strict=True))
    # The groups that overlap much are one, those of the chain stay apart; before, 60 * 100 rows were compared for the one.
    assert sorted(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) == [100, 100, 100, 100, 200]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == 100


def test_decontaminate(spark, docs, none):
    base = words(200, 1)
    items = [(1, " ".join(base[10:40])), (2, " ".join(w.upper() for w in words(70, 2)[5:18])), (10, "one,two"), (3, None), (4, ""), (5, "never seen words here"), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = lower_words(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = []
    for i, t, *_ in corpus():
        w, hit, found = lower_words(t), set(), set()
        for win, own in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= own - {None}
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = sorted((tuple(r) for r in fm_decontaminate.digest(docs, bench).collect()), key=str)
    assert got == sorted(want, key=str)
    small = fm_decontaminate.find(docs, bench, block_words=20)  # several passes
    assert sorted(str(r["hit_spans"]) for r in small.collect()) == sorted(str(r["hit_spans"]) for r in fm_decontaminate.find(docs, bench).collect())
    clean = fm_decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and fm_decontaminate.digest(clean, bench).where("contaminated").count() == 0
    assert fm_decontaminate.digest(none, bench).count() == 0 and fm_decontaminate.digest(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index():
    r = np.random.default_rng(1)
    text = r.integers(0, 4, 500)
    index = fm_decontaminate.FMIndex(text, 3)
    table = np.array([list(p) for p in {tuple(r.integers(1, 4, 3)) for _ in range(30)}])
    lo, hi = index.search(table, np.full(len(table), 3))
    for p, a, b in zip(table, lo, hi, strict=True):
        want = [i for i in range(498) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_bpe(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.WordBPE(bpe.default_path(), memo=50)
    r = random.Random(2)
    texts = [x for _, x, *_ in corpus()] + ["a<|endoftext|>b", "it's they'll 12", "ΑΣ Σ İ \x1c\x85x", "".join(r.choice("abctheing 'é中\n!") for _ in range(3000))]
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert own.encode(x) == ids and own.written(x)[1] == t.decode(ids, skip_special_tokens=False) == own.decode(ids)
    got = bpe.digest(docs).collect()
    assert len(got) == docs.count() and bpe.digest(none).count() == 0
    clash = bpe.with_tokens(docs.withColumn("ids", F.lit("x")))
    assert clash.columns == [*docs.columns, "ids", "n_tokens", "decoded"] and clash.where("n_tokens <> size(ids)").count() == 0


def test_bpe_keeps_words_that_come_again():
    """A word of every line is encoded once, however many others come between; the tables stay bounded."""
    own, met = bpe.WordBPE(bpe.default_path(), memo=50), []
    real = own.encode_word
    own.encode_word = lambda w: met.append(w) or real(w)
    for i in range(40):
        own.written(" ".join(["qqzzqq", *(f"w{chr(97 + i % 26)}x{chr(97 + k)}y{i}" for k in range(9)), "vvzzvv!"]))
        assert len(own.memo) <= 50 and len(own.older) <= 50
    assert met.count("qqzzqq") == met.count("vvzzvv") == 1  # before: again after every clearing


@pytest.mark.parametrize("shards", [3, 16])
def test_sharding(docs, none, shards):
    got = sharding.shard(docs, shards).collect()
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert len(got) == docs.count() and total == sum(len((t or "").encode()) + 1 for _, t, *_ in corpus())
    for s in range(shards):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= largest
    assert sharding.shard(none).count() == 0


def test_sharding_of_copies(spark):
    d = spark.createDataFrame([(i, "copy") for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(d, 7).groupBy("shard").count().collect()
    assert {r["count"] for r in got} <= {428, 429} and len(got) == 7


def test_chat_round_trip():
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assi\\n\nstant<|", "a<\\|b<|<\\\\|"), ("assistant", ""), ("assistant", "x\n")]
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == ["", "x\n"]
    with pytest.raises(ValueError):
        chat.parse_turns(text + "x")


def test_chat_trees(spark):
    rows = [(1, 1, None, 1.0, "user", "a"), (1, 2, 1, 0.5, "assistant", "b"), (1, 3, 1, 0.9, "assistant", "c"), (1, 4, 3, None, "user", None), (2, 5, 99, 0.0, None, "r"), (3, 7, 8, 0.0, "u", "x"), (3, 8, 7, 0.0, "u", "y")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    got = {(r["tree"], r["leaf"]): (r["rank"], [t for _, t in chat.parse_turns(r["formatted"])]) for r in chat.format_trees(nodes).collect()}
    assert got == {(1, 2): (1, ["a", "b"]), (1, 4): (2, ["a", "c", ""]), (2, 5): (1, ["r"])}
    assert [r["leaf"] for r in chat.format_trees(nodes.where("tree = 1"), branches=1).collect()] == [2]
    long = spark.createDataFrame([(1, i, i - 1 if i else None, 0.0, "u", str(i)) for i in range(100)], nodes.schema)
    assert [t for _, t in chat.parse_turns(chat.format_trees(long).first()["formatted"])] == [str(i) for i in range(100)]
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_chat_null_conversation(spark):
    """Rows without a conv_id are one conversation, apart from number 0."""
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (0, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    nodes = chat.from_conversations(rows)
    got = {r["tree"]: [t for _, t in chat.parse_turns(r["formatted"])] for r in chat.format_trees(nodes).collect()}
    assert got == {None: ["a", "b"], 0: ["c"]}
    found = {(r["tree"], r["leaf"], r["node"], r["dist"]) for r in chat.paths(nodes).collect()}
    assert found >= {(None, 2, 2, 0), (None, 2, 1, 1), (0, 1, 1, 0)}


def test_licenses(spark, docs, none):
    texts = [(1, "x\nLicensed under CC BY-NC 4.0.\ny"), (2, "MIT License, MIT license; the mit licenses"), (3, None), (4, "Licensed under the Apache License, Version 2.0."), (5, "version of the public"), (6, "é MIT\nLICENSE")]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 3, "cc-by", "cc-by,cc-by-nc-4.0")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (2, 0, 2, 7)
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"]) == (0, "", 0.0)
    assert "apache-2.0" in got[4]["labels"].split(",") and got[4]["score"] == 1.0 and got[5]["labels"] == ""
    assert (got[6]["first_word"], got[6]["n_words"]) == (1, 3)
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(none).count() == 0


def test_licenses_across_lines(spark):
    """Wrapped lines, a word missing, and the kinds of CC BY told apart."""
    texts = [
        (1, "x " * 70 + "Licensed under the Apache\nLicense, Version\n2.0."), (2, "Licensed under Apache License, Version 2.0"), (3, "Licensed under CC BY 4.0."),
        (4, "Licensed under CC BY-SA 4.0"), (5, "y " * 31 + "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this\nsoftware and associated documentation files"),
    ]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert "apache-2.0" in got[1] and "apache-2.0" in got[2] and got[3] == {"cc-by", "cc-by-4.0"} and got[4] == {"cc-by", "cc-by-sa-4.0"} and got[5] == {"mit-permission"}


@pytest.mark.parametrize("frequencies", [None, "reversed"])
def test_license_filters_lose_nothing(spark, frequencies):
    """All blocks against all templates by brute force, whatever the order of tokens."""
    r = random.Random(4)
    pool = sorted({w for t in license_scan.TEMPLATES.values() for w in t.split()})
    counts = {w: i for i, w in enumerate(reversed(pool))} if frequencies else None
    texts = []
    for i in range(150):
        parts = [r.sample(t.split(), r.randint(1, len(t.split()))) + r.sample(pool, 2) for t in r.sample(list(license_scan.TEMPLATES.values()), 2)]
        texts.append((i, "\n".join(" ".join(p + ["filler"] * r.choice([0, 40])) for p in parts)))
    texts += [(200 + i, t) for i, t in enumerate(license_scan.TEMPLATES.values())]
    got = {x["doc_id"]: {m["name"] for m in x["matches"]} for x in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), frequencies=counts).collect()}
    for i, text in texts:
        w = text.split()
        blocks = [w[at : at + license_scan.BLOCK] for at in range(0, len(w), license_scan.STEP)]
        hits = lambda n, t: any(len(set(t.split()) & set(b)) >= 0.8 * len(set(t.split())) - 1e-9 and f" {license_scan.TELLING.get(n, '')} ".replace("  ", " ") in f" {' '.join(b)} " for b in blocks)  # noqa: B023, E731
        assert got[i] == {n for n, t in license_scan.TEMPLATES.items() if hits(n, t)}
    assert all(n in got[200 + i] for i, n in enumerate(license_scan.TEMPLATES))


def labelled(spark, kind):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad, w = i % 3 == 0, words(r.randint(5, 120), 1000 + i)
        if bad and kind == "quality":
            w = [x.upper() + "!!" for x in w]
        if bad and kind == "toxic":
            w.insert(r.randrange(len(w)), r.choice(["idiot", "stupid", "worthless", "pathetic"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if kind == "toxic" else 1 - bad))
    rows += [(1000, None), (1001, ""), (None, "x"), (5, rows[5][1])]
    labels += [(None, 1), (7, None), (2000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {kind} int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, kind):
    docs, labels = labelled(spark, kind)
    module = gbt_quality if kind == "quality" else toxicity
    model = gbt_quality.fit(docs, labels, "quality", 4, 2) if kind == "quality" else toxicity.fit(docs, labels)
    got = module.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    right = [(r["score"] >= 0.7) == ((r["doc_id"] % 3 == 0) == (kind == "toxic")) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean(right) > 0.97
    blank = module.classify(docs, gbt_quality.fit(docs, labels.limit(0), "quality", 4, 2) if kind == "quality" else toxicity.fit(docs, labels.limit(0))).collect()
    assert len({r["score"] for r in blank}) == 1 and module.classify(docs.limit(0), model).count() == 0


def test_misspelled(spark):
    docs, labels = labelled(spark, "toxic")
    score = toxicity.fit(docs, labels).score(["nice abc words worthles here", "pathetik", "abc def gab"])
    assert score[0] > 0.7 and score[1] > 0.7 and score[2] < 0.5


def test_subword_rows(monkeypatch):
    def plain(word):
        raw, out = b"<" + word + b">", []
        for n in toxicity.NGRAMS:
            for i in range(len(raw) - n + 1):
                code = 0
                for c in raw[i : i + n]:
                    code = code * 0x100000001B3 + c
                out.append(((code + n) * 0x9E3779B97F4A7C15) % 2**64 >> 64 - toxicity.ROWS_LOG)
        return out

    assert np.allclose(toxicity.Bag(np.ones(toxicity.ROWS), 0.0).score(["a", "", None]), [1 / (1 + np.exp(-1 / toxicity.WINDOW)), 0.5, 0.5])
    some = [w.encode() for w in words(40, 3)] + [b"a", b"x" * 300, "zürich".encode(), b"b"]
    for piece in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(toxicity, "PIECE", piece, raising=False)
        for few in ([], [b"a"], [b"ab"], [b"abcd"], [b"a", b"b"], some):  # under seven bytes together: longer n-grams find no place at all
            rows, start = toxicity.grams(few)
            assert [x.tolist() for x in np.split(rows, start[1:])][: len(few)] == [plain(w) for w in few]
            assert np.allclose(toxicity._means(np.arange(toxicity.ROWS) / 7, rows, start), [np.mean(plain(w)) / 7 for w in few])


def test_subword_training_memory(monkeypatch):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(r.choices(letters, k=30_000 if i % 10 == 0 else 8)) + " " + " ".join("".join(r.choices(letters, k=8)) for _ in range(500)) for i in range(60)]
    y = np.arange(60) % 2
    tracemalloc.start()
    try:
        toxicity.train(iter(texts), y, epochs=1)
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 50e6  # 124 MB when n-grams were all worked on at once and wide


def test_subword_long_words(monkeypatch):
    few, y = ["idiot here", "nothing here " * 3, "an idiot", "fine words"], np.array([1, 0, 1, 0])
    monkeypatch.setattr(toxicity, "STEP", 1, raising=False)
    plain = toxicity.train(few, y, epochs=3)
    monkeypatch.setattr(toxicity, "STEP_GRAMS", 1, raising=False)  # each window is a bag of rows
    bags = toxicity.train(few, y, epochs=3)
    assert np.allclose(plain.weight, bags.weight, atol=1e-9) and abs(plain.bias - bags.bias) < 1e-9
    assert (toxicity.train(few, y).score(["what an idiot", "fine here"]) > 0.5).tolist() == [True, False]
    monkeypatch.undo()
    long = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    tracemalloc.start()
    try:
        score = toxicity.train([f"an idiot {long}", "nothing here", "fine words"], np.array([1, 0, 0])).score([long, "fine"])
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 80e6  # 299 MB when a window of long words was learned from gram by gram
    assert score[0] > score[1]


def test_ann(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[50].tolist()) for i in range(20)]
    rows += [(6000, None), (6050, [0.0] * 24), (6100, [float("nan")] * 24), (6150, [None] * 24), (6200, [1.0]), (None, x[0].tolist()), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = additive_ann.search(df, df.where("vec_id % 50 = 0"), 5, block=1000, query_block=20).collect()
    ids = np.array([i for i, _ in rows[:3020]])
    v = np.array([np.float32(e) for _, e in rows[:3020]], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in {g["query_id"] for g in got}:
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        want = ids[np.lexsort((ids, -s.round(12)))][:5]
        mine = [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q]
        hit, total = hit + len(set(want) & set(mine)), total + 5
        if q == 50:
            assert mine == [5000, 5001, 5002, 5003, 5004]
    assert len({g["query_id"] for g in got}) == 61 and hit / total >= 0.9
    few = additive_ann.search(df.limit(3), df.limit(3), 5).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {2}
    assert additive_ann.search(df.limit(0), df, 5).count() == 0


def test_ann_finds_all_nearest(spark):
    """On rows that codes tell apart badly: tight groups, a large common part, many dimensions, two lengths, and numbers whose squares overflow."""
    r = np.random.default_rng(1)
    groups = r.normal(size=(3, 24))[r.integers(0, 3, 1200)] + 1e-4 * r.normal(size=(1200, 24))
    parts = [groups.astype(np.float32), np.float32(1e4 + r.normal(size=(1200, 24))), np.float32(r.normal(size=(1000, 300))), 1e200 * r.normal(size=(100, 24)), np.repeat(r.normal(size=(1, 24)), 900, 0)]
    rows = [(i, v.tolist()) for i, v in enumerate(v.astype(float) for part in parts for v in part)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for g in additive_ann.search(df, df.where("vec_id % 50 = 0"), 5, block=1500, query_block=60).orderBy("rank").collect():
        got.setdefault(g["query_id"], []).append((g["vec_id"], g["score"]))
    assert sorted(got) == list(range(0, len(rows), 50))
    for width in (24, 300):
        ids = np.array([i for i, v in rows if len(v) == width])
        v = np.array([v for _, v in rows if len(v) == width])
        v /= abs(v).max(1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for at in np.flatnonzero(ids % 50 == 0):
            s = v @ v[at]
            s[at] = -9
            mine = got[ids[at]]
            assert len({i for i, _ in mine} - {ids[at]}) == 5
            assert np.abs(s[np.searchsorted(ids, [i for i, _ in mine])] - np.sort(s)[:-6:-1]).max() < 1e-13
            assert np.abs(np.array([x for _, x in mine]) - np.sort(s)[:-6:-1]).max() < 1e-13
    copies = range(len(rows) - 900, len(rows))
    assert all([i for i, _ in got[q]] == [i for i in copies if i != q][:5] for q in got if q in copies)
