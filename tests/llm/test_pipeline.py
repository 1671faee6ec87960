"""The pipeline's stages against plain versions of their decisions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, check_packed, ids_of, plain_quality, plain_targets

import corpus_pipeline as P
from mergelake.llm import langid, places
from mergelake.llm.bpe import pieces
from mergelake.llm.queries import queries, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_kept(rows, limit=25, share=0.5):
    """Rows that pass the base rules and keep half of their words outside lines of more than ``limit`` documents of their source."""
    norm = lambda line: re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" ")
    lines = [{norm(x) for x in (r["text"] or "").split("\n") if norm(x)} for r in rows]
    counts = Counter((r["source"], x) for r, own in zip(rows, lines, strict=True) for x in own)
    kept = []
    for r in rows:
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
        left = sum(words(x) for x in (r["text"] or "").split("\n") if counts[r["source"], norm(x)] <= limit)
        if not plain_quality(r["text"])[5] and left >= share * words(r["text"] or ""):
            kept.append(r)
    return kept


def near_groups(rows):
    """Of each row the first row reachable over pairs with a Jaccard similarity of 0.8 of five-word shingles."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "") for r in rows]
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (re.findall(r"[^\x20\x09-\x0D]+", t) for t in words)]
    having = defaultdict(list)
    for i, own in enumerate(shingles):
        for x in own:
            having[x].append(i)
    group = list(range(len(rows)))
    for i, own in enumerate(shingles):
        for j, n in Counter(j for x in own for j in having[x] if j < i).items():
            if group[i] != group[j] and n >= 0.8 * (len(own) + len(shingles[j]) - n):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        learn = docs
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = docs.collect()
        if name != "pack_sequences":
            assert docs.columns == COLUMNS and set(after) <= set(before)
        if name == "language_id":
            prototypes = langid.fit_prototypes(learn.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
            want = {r["doc_id"] for r in langid.identify(learn, prototypes).where(f"lang_pred <> 'und' AND score >= {P.LEAST_LANGUAGE_SCORE}").collect()}
            assert {r["doc_id"] for r in after} == want and len(after) >= 0.99 * len(before)
        if name == "quality_rules":
            assert Counter(after) == Counter(plain_kept(before))
        if name == "near_duplicates":
            groups = dict(zip(before, near_groups(before), strict=True))
            assert sorted(groups[r] for r in after) == sorted(set(groups.values()))
        if name == "mix_sources":
            size = lambda r: len(r["text"].encode().split())
            had, got, times = Counter(), Counter(), Counter(after)
            for r in before:
                had[r["source"]] += size(r)
                got[r["source"]] += size(r) * times[r]
            largest = max(map(size, before))
            assert max(times.values()) <= 3 and all(abs(got[s] - t) <= max(largest, 0.02 * t) for s, t in plain_targets(had).items())
        if name == "pack_sequences":
            each = Counter(r["doc_id"] for r in before)
            lengths = np.array([r["length"] for r in after])
            tool = pieces(tokenizer_path()).tokenizer
            assert lengths.sum() == sum(len(ids_of(tool, r["text"])) + 1 for r in before) and lengths.max() <= 1024
            once = {r["doc_id"]: r["text"] for r in before if each[r["doc_id"]] == 1}
            sequences = Counter()
            for r in after:
                sequences[r["sequence_id"]] += r["length"]
            assert max(sequences.values()) <= 1024 and {r["doc_id"] for r in after} == set(each) and once


def test_packing_of_distinct_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = P.pack_sequences(spark, docs, sf_dir).collect()
    assert check_packed(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, pieces(tokenizer_path()).tokenizer, 1024) > 0.8


TEXT = " ".join(f"wort{i}" for i in range(90))
ODD = [(1, None, None, None, None), (1, TEXT, "de", None, 5), (1, TEXT, "de", None, 5), (None, TEXT + " ende", "de", "s", 5), (2, "", "de", "s", 0), (3, LONG, "de", "s", 7), (4, TEXT.replace("wort", "haus"), "de", "s", 1)]
CLASHES = ["_row", "copies", "place", "place_file", "place_row", "file", "block", "at", "n", "rows", "kept", "id", "host", "size", "target", "component_id", "node", "bits", "keys", "_copy", "row", "lead"]


@pytest.fixture
def odd(spark, tmp_path):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({c: F.concat(F.lit(c), F.col("n_chars").cast("string")) for c in CLASHES}).withColumn("PLACE_1", F.lit(1)).write.parquet(f"{tmp_path}/odd")
    return spark.read.parquet(f"{tmp_path}/odd")


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows_and_clashing_columns(spark, sf_dir, odd, name):
    """Nulls, repeats, null ids, a long text, and columns named like the stages' own go through every stage as they are."""
    before = Counter(odd.collect())
    out = dict(P.STAGES)[name](spark, odd, sf_dir)
    after = Counter(out.collect())
    if name == "pack_sequences":
        assert {r["doc_id"] for r in after} == {1, None, 2, 3, 4}
        return
    assert out.columns == odd.columns and set(after) <= set(before) and out.schema == odd.schema
    kept = Counter((r["doc_id"], (r["text"] or "")[:5]) for r in after.elements())
    if name == "language_id":
        assert sum(kept.values()) == 5
    if name == "quality_rules":
        assert kept == {(1, "wort0"): 2, (None, "wort0"): 1, (4, "haus0"): 1}
    if name == "near_duplicates":
        assert sum(kept.values()) == 4 and kept[4, "haus0"] == 1 and kept[3, "wort "] == 1
    if name == "mix_sources":
        assert max(after.values()) <= 6 and not any(not (r["text"] or "").split() for r in after)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_table(spark, sf_dir, odd, name, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/none")
    none = spark.read.parquet(f"{tmp_path}/none")
    out = dict(P.STAGES)[name](spark, none, sf_dir)
    assert out.count() == 0 and (name == "pack_sequences" or out.columns == odd.columns)


def test_verdicts_by_place(spark, tmp_path, monkeypatch):
    """Every row as often as its verdict says, over several files, blocks and batches, in its partition."""
    monkeypatch.setattr(places, "BLOCK", 64)
    spark.range(1000).select(F.col("id"), (F.col("id") % 4).alias("times")).repartition(3).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    rows = places.placed(docs, "p")
    got = Counter(r["id"] for r in places.taken(docs, rows.where("times > 0"), "p", "times").collect())
    assert got == {i: i % 4 for i in range(1000) if i % 4}
    out = places.taken(docs, rows.where("id < 10"), "p")
    assert sorted(r["id"] for r in out.collect()) == list(range(10)) and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert places.taken(docs, rows.limit(0), "p").count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_four_fifths_go(spark, sf_dir, tmp_path):
    """Copies with words changed in a few places, of similarity 0.8 to 0.9, are linked, also by way of others; those below stay."""
    rows, near, below = [], set(), set()
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(300)]
        rows.append((len(rows), " ".join(words)))
        for c in range(3):  # each changes other words; of two copies the similarity is below 0.8
            copy = list(words)
            for i in range(5 * (1 + c) + 1, 300, 60):
                copy[i] = f"c{c}"
            (near if jaccard(" ".join(words), " ".join(copy)) >= 0.8 else below).add(len(rows))
            rows.append((len(rows), " ".join(copy)))
        for i in range(2, 300, 30):
            words[i] = "far"
        assert jaccard(rows[-4][1], " ".join(words)) < 0.8
        below.add(len(rows))
        rows.append((len(rows), " ".join(words)))
    assert len(near) == 120 and len(below) == 40
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = {r["doc_id"] for r in P.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), sf_dir).collect()}
    assert below <= kept and len(kept) == 80
    assert all(len({5 * g + c for c in range(4)} & kept) == 1 for g in range(40))


def test_near_duplicates_against_all_pairs(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.collect()
    groups = dict(zip(before, near_groups(before), strict=True))
    kept = P.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(groups[r] for r in kept) == sorted(set(groups.values()))


@pytest.mark.parametrize("hot", [8192, 8])
def test_dense_families_against_all_pairs(spark, hot):
    """Families around 0.8, whose bands hold many nodes that the least one is not like: nobody is lost, whole keys or split ones."""
    from mergelake.llm import simhash

    rng, rows = np.random.default_rng(11), []
    for family in range(3):
        base = [f"f{family}x{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for i in rng.choice(120, int(rng.integers(1, 6)), replace=False).tolist():
                words[i] = f"r{rng.integers(1 << 30)}"
            rows.append({"doc_id": len(rows), "text": " ".join(words)})
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, "doc_id", hot=hot).collect()}
    assert [got[i] for i in range(len(rows))] == near_groups(rows)


def test_boilerplate_family_in_a_large_source(spark, sf_dir, tmp_path):
    """Texts that share most of their lines go, whether or not their source has many other texts; those others stay."""
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    lines = "\n".join(" ".join(f"b{k}x{j}" for j in range(12)) for k in range(6))
    rows = [(1000 * h + i, f"{lines}\n{own(1000 * h + i, 20)}", h) for h in (10, 11) for i in range(40)] + [(20_000 + i, own(20_000 + i, 60), 10) for i in range(5000)]
    spark.createDataFrame([(i, t, "en", f"s{h}", len(t)) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in")
    kept = {r["doc_id"] for r in P.quality_rules(spark, spark.read.parquet(f"{tmp_path}/in"), sf_dir).collect()}
    assert kept == {20_000 + i for i in range(5000)}


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 0
    assert "pipeline" not in queries() and [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mix_sources", "pack_sequences"]


def test_sketches_estimate_similarity():
    from mergelake.llm import simhash

    rng = np.random.default_rng(5)
    for size in (3, 40, 4000):
        for share in (0.3, 0.82, 1.0):
            a = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2)
            both = max(1, round(size * 2 * share / (1 + share)))
            b = np.concatenate([a[:both], rng.integers(0, 1 << 63, size - both, np.uint64)])
            true = both / (2 * size - both)
            x, y = (np.frombuffer(simhash.sketch(v), np.uint8)[None, :] for v in (a, b))
            assert simhash.may_be_similar(x, y, 0.8)[0] or true < 0.8
            assert not (size == 4000 and share == 0.3 and simhash.may_be_similar(x, y, 0.8)[0])
    assert not any(simhash.sketch(np.empty(0, np.uint64)))
