"""The five stages on whole texts against brute force, with nulls, empty texts, repeated rows and columns in the way."""

import random

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from timberline.llm import bpe, gbt_quality  # noqa: E402
from timberline.llm.common import lower_words  # noqa: E402

R = random.Random(77)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(4000)]
EXTRA = ("score", "stats", "hit_items", "hit_spans", "_quality", "ids", "row")


def words(n):
    return [R.choice(VOCAB) for _ in range(n)]


def corpus():
    phrase, passage, base, other = words(16), words(70), words(150), words(120)
    near, texts = list(base), []
    near[70] = "changed"
    texts += [" ".join(base), " ".join(near), " ".join(base)]  # two of one group go
    texts += [" ".join(words(60) + passage + words(60)), " ".join(words(80) + passage + words(90))]  # the passage goes once
    texts += [" ".join(words(20) + phrase + words(20)), " ".join(words(600) + phrase + words(100))]  # a leak goes, a trace is cut
    texts += [" ".join(other), " ".join(other[:60] + words(60))]
    texts += ["\n".join(" ".join(words(9)) for _ in range(40)), " ".join(words(6000)), None, "", "one"]
    texts += [" ".join(w.upper() + "!!" for w in words(60)) for _ in range(3)]  # junk
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = []
    for i in range(400):
        bad, w = i % 2 == 0, words(R.randint(30, 200))
        rows.append((1000 + i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), "en", "s", 0))
        labels.append((1000 + i, 0 if bad else 1))
    rows += [(7, texts[7], "en", "s", 0), (None, texts[9], None, None, None)]
    return rows, labels, [("b1", " ".join(phrase)), ("b2", None)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels, benchmark = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.selectExpr("*", *[f"'{c}' as {c}" for c in EXTRA]).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, benchmark


def near_kept(docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for _, t in docs)]
    group = list(range(len(docs)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            if a and len(a & sets[y]) * 100 >= 75 * len(a | sets[y]):
                group[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return [(i, t) for x, (i, t) in enumerate(docs) if i is None or not sets[x] or least[top(x)] == i]


def cut_repeats(docs):
    last, first = 1 << 63, {}
    for i, t in docs:
        w = (t or "").split()
        for s in range(len(w) - 49):
            key = tuple(w[s : s + 50])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t in docs:
        w, gone = (t or "").split(), set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < (last if i is None else i):
                gone |= set(range(s, s + 50))
        out.append((i, [x for p, x in enumerate(w) if p not in gone]))
    return out


def cut_leaks(docs, benchmark):
    windows = set()
    for _, t in benchmark:
        w = lower_words(t)
        windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12))} if w else set()
    out = []
    for i, w in docs:
        low, gone = [x.lower().encode() for x in w], set()
        for s in range(len(low)):
            if tuple(low[s : s + 13]) in windows:
                gone |= set(range(s, s + 13))
        if not gone or 20 * len(gone) < len(w):
            out.append((i, [x for p, x in enumerate(w) if p not in gone]))
    return out


def test_pipeline(spark, run):
    at, rows, benchmark = run
    got = corpus_pipeline.run(spark, at)
    assert set(EXTRA) - {"ids"} < set(got.columns) and len(set(got.columns)) == len(got.columns)
    got = got.collect()

    documents, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = gbt_quality.fit(documents, labels, "quality", 4, 2)
    good = [bool(s >= corpus_pipeline.THRESHOLD) for s in model.score(__import__("numpy").stack([gbt_quality.statistics(t) for _, t, *_ in rows]))]
    kept = [(i, t) for (i, t, *_), ok in zip(rows, good, strict=True) if ok]
    assert 150 < len(kept) < 260
    want = cut_leaks(cut_repeats(near_kept(kept)), benchmark)
    assert sorted(((r["doc_id"], (r["text"] or "").split()) for r in got), key=str) == sorted(want, key=str)
    ids = {r["doc_id"] for r in got}
    assert 0 in ids and not ids & {1, 2, 5}

    tokenizer = Tokenizer.from_file(bpe.default_path())
    for r in got:
        assert list(r["ids"]) == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == tokenizer.decode(list(r["ids"]), skip_special_tokens=False) and r["score"] == "score" and r["row"] == "row"


def test_empty_tables(spark, run):
    at, *_ = run
    none = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, at)
        assert out.count() == 0 and (name == "tokens" or out.columns == none.columns)


@pytest.mark.parametrize("step", ["quality", "near_duplicates", "substrings"])
def test_tokenizer_goes(spark, run, step):
    """A worker that has encoded texts holds no tokenizer any more once another stage's step has run in it."""
    import pyarrow as pa

    from timberline.llm import parity_join, rlz_dedup

    at, *_ = run
    few = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").limit(3)
    model = gbt_quality.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"), "quality", 4, 2)
    make = {"quality": lambda d: gbt_quality.classify(d, model), "near_duplicates": parity_join.sets_of, "substrings": rlz_dedup.contexts}[step]
    path = bpe.default_path()

    class Docs:  # stands for a table: runs the step's function in this process
        columns, dtypes = few.columns, few.dtypes

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            list(f(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "k": [1], "th": [1], "text": ["a b c"]})])))

    held = bpe.load(path)
    assert bpe.load(path) is held
    make(Docs())
    assert bpe.load(path) is not held
