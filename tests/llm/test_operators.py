"""Each operator against a plain version of itself, and on odd input: nulls, empty and long texts, repeats, no rows, extra columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from mergelake.llm import ann, langid, licenses, mixing, packing, quality, simhash, tokens, toxicity, warc
from mergelake.llm.bpe import pieces
from mergelake.llm.queries import oracle_sql, queries, tokenizer_path

LONG = "wort " * 120_000
ODD = [(1, None, None, "a"), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one two three four five", "en", "b"), (4, "one two three four five", "en", "b"), (None, "déjà vu, déjà vu", "fr", None), (7, LONG, "de", "a"), (8, "<|endoftext|> x", "en", "b"), (9, "123 !!!", None, "b")]
EXTRA = ["n_tokens", "score", "bits", "row", "size", "host", "label", "group_key", "mix_source", "key", "rank", "component_id", "licenses", "_text", "kept"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="module")
def reference():
    return pieces(tokenizer_path()).tokenizer


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


# licence scans


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.rows(queries()[name](spark, sf_dir).toPandas()) == oracle.rows(con.execute(oracle_sql()[name]).df())


def test_license_table_is_consistent():
    ids = set(licenses.SENTENCES)
    assert all(set(rule) <= ids for _, rule in licenses.RULES)
    every = [s for ss in licenses.SENTENCES.values() for s in ss]
    assert len(every) == len(set(every))
    assert all(any(t in s for t in licenses.TRIGGERS) for s in every)
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in every)


def test_license_cases(spark, odd):
    mit = "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    cases = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, mit), (3, "Licensed under the Apache License, Version 2.0. All rights reserved."), (4, "not licensed under anything"), (5, "LICENSED   under CC BY-NC 4.0")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(1, 6)] == ["MIT", "MIT", "All-rights-reserved,Apache-2.0", "", "CC-BY-NC-4.0"]
    assert got[3]["sentence_ids"] == "apacheRef allRights"
    out = licenses.scan(odd)
    assert out.count() == len(ODD) and out.where("licenses <> '' OR n_licenses <> 0 OR n_unmatched <> 0").count() == 0
    assert licenses.scan(odd.limit(0)).count() == 0


GPL = "This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n"
USEFUL = "\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n"
SPDX = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "AGPL-3.0-only": "AGPL-3.0", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause", "MPL-2.0": "MPL-2.0"}


def test_license_sentences_survive_cutting(spark):
    """In their usual spelling sentences run across colons, semicolons and full stops."""
    cases = [(f"// SPDX-License-Identifier: {x}\nint x;", y) for x, y in SPDX.items()] + [(f"License: {x}", y) for x, y in (("MIT", "MIT"), ("Apache 2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3.0"))]
    cases += [(GPL.format(*marks, v) + rest, f"GPL-{v}.0-or-later") for v in (2, 3) for marks in (":,", ";;", ";,", ",;", ",,") for rest in ("", USEFUL)]
    cases += [("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */", "MPL-2.0")]
    cases += [("Content is available under CC BY-SA 3.0 unless otherwise noted.", "CC-BY-SA"), ("Er kam\nmit\nihr. Section\n2.0", "")]
    rows = [(i, text) for i, (text, _) in enumerate(cases)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(cases[i][0], r["licenses"]) for i, r in sorted(got.items())] == cases
    lines = [(i, " ".join(text.split("\n"))) for i, text in rows[len(SPDX) + 3 : -3]]  # the notice unwrapped: its parts are all taken
    assert licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).where("n_unmatched > 0").count() == 0


def test_license_every_entry_survives_cutting(spark):
    """Each known sentence, with the marks that usually stand in it, gives its licence or is cut into known parts."""
    usual = [("spdx license identifier ", "spdx license identifier: "), (r"^license (?=mit|apache|gpl)", "license: "), ("free software you can", "free software; you can"), ("foundation either", "foundation; either"), ("any warranty without", "any warranty; without"), ("license v 2 0", "license, v. 2.0"), ("noted license", "noted. license"), ("mit license see the", "mit license. see the")]
    every = [s for known in licenses.SENTENCES.values() for s in known]
    spelled = []
    for i, s in enumerate(every):
        text = s
        for plain, marked in usual:
            text = re.sub(plain, marked, text)
        if text != s:
            spelled += [(2 * i, s), (2 * i + 1, text)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(spelled, "doc_id long, text string")).collect()}
    assert len(spelled) > 40
    for n, text in spelled[1::2]:
        assert got[n]["licenses"] == got[n - 1]["licenses"] and got[n]["sentence_ids"], text


def test_license_triggers_see_normal_forms(spark):
    """Marks and comment signs inside a trigger do not hide it."""
    cases = [(1, "All rights-reserved."), (2, "released into the public-domain"), (3, "# All rights\n# reserved"), (4, "This is free and unencumbered software released into the public-domain.")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == {1: "All-rights-reserved", 2: "", 3: "All-rights-reserved", 4: "Unlicense"}


# token counts


def test_pieces_are_the_library_s(reference):
    tool, r = pieces(tokenizer_path()), random.Random(1)
    alphabet = "ab1 '\n\t  .,!<|>éßд中٣²　 😀ʼs're\U00010400͸"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) + ("<|endoftext|>" if r.random() < 0.1 else "")
        want = ids_of(reference, text)
        assert np.frombuffer(tool.ids(text), "<u4").tolist() == want
        segments, n = tool.segments(text)
        assert n + sum(tool.count(p) for s in segments for p in tool.pretokens(s)) == len(want)


@pytest.mark.parametrize("block", [1, 50_000, 1 << 25])
def test_token_counts(docs, texts, reference, block):
    got = tokens.count_tokens(docs, tokenizer_path(), block_bytes=block).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]["text"]
        n = len(ids_of(reference, text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_token_counts_odd(odd, reference):
    got = tokens.count_tokens(odd, tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(ids_of(reference, t))) for i, t, *_ in ODD)
    assert tokens.count_tokens(odd.limit(0), tokenizer_path()).count() == 0


# nearest neighbours


def brute(vectors, asks, k):
    out = {}
    for q, x in vectors:
        if asks(q):
            scored = sorted((-float((np.array(x) * np.array(y)).sum()), i) for i, y in vectors if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def found(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_neighbours_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want, got = brute(vectors, lambda q: q % 20 == 0, 20), found(queries()["op3_nearest_neighbours"](spark, sf_dir))
    hits = [len({i for _, i, _ in got[q]} & set(w)) / 20 for q, w in want.items()]
    assert np.mean(hits) >= 0.9
    at = dict(vectors)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(abs(s - float(np.dot(at[q], at[i]))) < 1e-12 for _, i, s in rows)
        assert rows == sorted(rows, key=lambda x: (-x[2], x[1])) or [x[1:] for x in rows] == [x[1:] for x in sorted(rows, key=lambda x: (-x[2], x[1]))]


def test_neighbours_of_near_copies(spark):
    """A third of all rows lies in one tight group, longer than a chunk; its members are told apart."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=32)
    rows = [(i, (middle + 0.05 * rng.normal(size=32) if i % 3 == 0 else rng.normal(size=32)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows, lambda q: q % 150 == 0, 10), found(ann.search(df, F.col("vec_id") % 150 == 0, k=10, rerank=64))
    assert np.mean([len({i for _, i, _ in got[q]} & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_neighbours_odd(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [0.5, None]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "list": F.lit(2), "rank": F.lit(0)})
    got = found(ann.search(df, F.col("vec_id") % 20 == 0))
    assert {q: [(r, i) for r, i, _ in x] for q, x in got.items()} == {0: [(1, 1), (2, 2), (3, 8)]}  # ties by id; all there are
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 3"), F.col("vec_id") % 20 == 0).count() == 0


# quality rules


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base(spark, docs, texts):
    for r in quality.rate(docs).collect():
        assert tuple(r)[1:7] == plain_quality(texts[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_lines(spark):
    """A line in many documents of its host is removed there alone; documents of little else are rejected, copies of each other too."""
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    banner = " ".join(f"b{j}" for j in range(60))
    rows = [(i, f"{own(i, 100)}\n  {banner.upper()}  ", "h") for i in range(40)] + [(100 + i, f"{banner}\n{own(100 + i, 20)}", "h") for i in range(5)]
    rows += [(200, f"{banner}\n{own(200, 20)}", "other"), (201, f"{banner}\n{own(201, 20)}", None)] + [(300 + i, own(300, 80), "copies") for i in range(60)]
    rows += [(400 + i, own(400, 80), "few") for i in range(25)] + [(500 + i, own(500 + i, 80), "copies") for i in range(5000)]
    got = {r["doc_id"]: r for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] and got[i]["left_words"] == 100 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(5)) and got[100]["left_words"] == 20
    assert got[200]["kept"] and got[201]["kept"]
    assert not any(got[300 + i]["kept"] for i in range(60))  # however many other documents their host has
    assert all(got[400 + i]["kept"] for i in range(25)) and all(got[500 + i]["kept"] for i in range(5000))
    share = {r["doc_id"]: r for r in quality.rate(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.02).collect()}
    assert all(share[300 + i]["kept"] for i in range(60)) and not any(share[100 + i]["kept"] for i in range(5))


def test_quality_odd(odd):
    got = quality.rate(odd).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in got) == Counter((i, *plain_quality(t)) for i, t, *_ in ODD)
    assert quality.rate(odd.limit(0)).count() == 0


# toxicity


def test_fold():
    assert toxicity.fold("L0SER, ｓｃｕｍ, ѕtuріd! 1d10t") == toxicity.fold("loser scum stupid idiot")
    assert toxicity.fold("looooser pathétic $cum") == toxicity.fold("loser pathetic scum")
    assert toxicity.fold(None) == "  "


def toxic_corpus(spark, n=600):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(20, 80))], i % 5 == 0
        for _ in range(4 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["vrakku", "Vr4kku", "grobzik", "gr0bzik", "zopperwitz"])
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_held_out(spark):
    df = toxic_corpus(spark)
    truth = {r["doc_id"]: r["toxic"] for r in df.collect()}
    got = toxicity.score_held_out(df.drop("toxic"), df.select("doc_id", "toxic")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def plain_weight(lexicon, text):
    """Every occurrence of every entry, by looking at each place of the folded text, unless some phrase's occurrence holds it."""
    folded = toxicity.fold(text)
    places = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    spared = [(i, i + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for i in places(p)]
    return sum(w for e, w in lexicon.weights.items() for i in places(e) if not any(a <= i and i + len(e) <= b for a, b in spared))


def test_toxicity_matcher_against_every_place(spark):
    """Random texts over few letters, with entries and phrases that overlap and hold each other."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    for _ in range(150):
        entries = {f" {word()}" + r.choice(["", " "]): float(r.randint(1, 9)) for _ in range(6)}
        phrases = tuple({toxicity.fold(" ".join(word() for _ in range(r.randint(1, 3)))) for _ in range(r.randint(0, 4))} - set(entries))
        lexicon = toxicity.Lexicon(entries, (0.0, 1.0, 1.0), phrases)
        text = " ".join(word() for _ in range(r.randint(0, 30)))
        assert toxicity.measure(lexicon.automaton(), text)[0] == plain_weight(lexicon, text)


def test_toxicity_on_given_labels(spark, docs, texts, sf_dir):
    """The registered query's weights are the plain matcher's, and its held-out predictions those of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.fit(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    got = {r["doc_id"]: r for r in queries()["op5_toxicity"](spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["weight"] == pytest.approx(plain_weight(lexicon, texts[i]["text"]))


def test_toxicity_learns_exceptions(spark):
    """A toxic word that clean documents have in one phrase counts everywhere but there."""
    r = random.Random(15)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(4, 8)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words[7] = words[21] = "vrakku"
        elif i % 60 == 1:
            words[9:11] = ["vrakku", "blossom"]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert toxicity.fold("vrakku blossom") in lexicon.exceptions and toxicity.fold("vrakku") in lexicon.weights
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(df, lexicon).collect()}
    assert all(got[i] == toxic for i, _, toxic in rows)


def test_toxicity_exceptions_and_odd(spark, odd):
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 5.0}, (-2.0, 1.0, 1.0))
    df = spark.createDataFrame([(1, "you are trash"), (2, "put it in the trash can"), (3, "trashy")], "doc_id long, text string")
    weights = {r["doc_id"]: r["weight"] for r in toxicity.score(df, lexicon).collect()}
    assert weights == {1: 5.0, 2: 0.0, 3: 0.0}
    out = toxicity.score(odd, lexicon).collect()
    assert len(out) == len(ODD) and len({r["score"] for r in out}) == 1
    assert toxicity.score(odd.limit(0), lexicon).count() == 0
    none = toxicity.score_held_out(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("predicted = 1").count() == 0 and none.count() == len(ODD)


# packing


def test_first_fit_decreasing():
    r = random.Random(2)
    for _ in range(50):
        sizes = np.array([r.randint(1, 100) for _ in range(r.randint(1, 80))])
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            b = next((j for j, x in enumerate(room) if x >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - room[b])
            room[b] -= sizes[i]


def check_packed(rows, texts, reference, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda x: x["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids, at = [*ids_of(reference, texts[i]), 0], 0
        for r in sorted(parts, key=lambda x: x["start"]):
            piece = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(piece, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_packing(docs, texts, reference):
    rows = packing.pack(docs, tokenizer_path(), group_docs=50).collect()
    assert check_packed(rows, {i: r["text"] for i, r in texts.items()}, reference, 1024) > 0.93


def test_packing_odd(odd, reference):
    rows = packing.pack(odd, tokenizer_path(), capacity=64).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(reference, t)) + 1 for _, t, *_ in ODD)
    assert Counter(r["doc_id"] for r in rows)[1] == 1
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


# WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://www.Example.com/b?x=1", "same"), (2, "https://example.com:8080/a", "same"), (3, None, None), (4, "no host", ""), (None, "http://a/", "same"), (5, "http://[bad", "é\r\n\r\n"), (6, "http://z/", LONG), (6, "http://z/", LONG), (7, "http://z/\nq", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit(2), "size": F.lit(3), "row": F.lit(4)})
    got = warc.archive(df).collect()
    assert len(got) == len(pages)
    first: dict = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    text = {i: h or "" for i, _, h in pages}
    for r in got:
        payload = text[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        response = r["page_id"] == first[payload.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if response else ("revisit", first[payload.decode()]))
        assert r["payload"] == (bytearray(payload) if response else None)
    few = warc.archive(df, least_bytes=5).where("record_type = 'revisit'").collect()
    assert few == [] or all(r["payload_bytes"] >= 5 for r in few)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_record_ids_and_readers(spark, tmp_path):
    """Every record has an id of its own, also of repeated pages; ids that are text come back as they were; readers follow the bytes."""
    ids = ["null", "a b", "x\r\ny", "ü/%", "null", None]
    df = spark.createDataFrame([(i, f"http://h/{n}", "same") for n, i in enumerate(ids)], "page_id string, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = warc.archive(df, folder=folder)
    assert Counter(r["page_id"] for r in got.collect()) == Counter(ids)
    assert {r["refers_to"] for r in got.collect()} == {None, "a b"}
    names = []
    for path in (tmp_path / "w").glob("warc-*"):
        names += re.findall(rb"WARC-Record-ID: (\S+)", gzip.decompress(path.read_bytes()))
    assert len(names) == len(set(names)) == len(ids)
    captures = spark.range(100).select(F.col("id").alias("row"), F.col("id").cast("string").alias("url_key"), F.lit("f").alias("file"), F.lit(0).alias("offset"), F.lit(warc.READ_BYTES).alias("length"))
    assert "RangePartitioning" in (plan := warc.read_archives(captures, folder, [])._jdf.queryExecution().toString()) or "rangepartitioning" in plan
    assert re.search(r"(?i)rangepartitioning\(.*, 100\)|RepartitionByExpression.*100", plan)


def test_warc_index(spark, tmp_path):
    """Binary search over several shards and blocks finds every capture and nothing else."""
    rows = [(str(i), f"http://h{i % 7}.example.com/{i}", f"p{i}".encode(), None) for i in range(500)]
    df = spark.createDataFrame(rows, "page string, url string, payload binary, refers_to string").repartition(5)
    folder = f"file://{tmp_path}/w"
    captures = warc.write_archives(df, folder)
    shards = warc.write_index(captures, folder, block_lines=16)
    index = warc.Index(folder, shards)
    for r in captures.collect():
        assert index.find(r["url_key"], r["row"]) == (r["file"], r["offset"], r["length"])
        assert index.find(r["url_key"], -1) is None
    assert index.find("", 0) is None and index.find("zzz", 0) is None
    assert warc.url_key("HTTP://WWW.Example.com:80/A?b") == "com,example,www)/a?b"


# language identification


def test_language_accuracy(docs, texts):
    got = langid.identify_held_out(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    long = [r for r in got if r["held_out"] and len(texts[r["doc_id"]]["text"]) > 200]
    assert np.mean([r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in long]) >= 0.97


def test_language_matches_plain_bundles(docs, texts):
    """Prototypes and cosines by hand: n-gram vectors bound from rotated letters, summed one by one."""
    made = langid.Vectors(256)
    some = docs.limit(40)
    picked = some.collect()

    def profile(text):
        clean = " " + re.sub(r"[^a-zà-ÿß]+", " ", text.lower()).strip() + " "
        total, n = np.zeros(256), Counter(clean[i : i + 3] for i in range(len(clean) - 2))
        for gram, count in n.items():
            v = np.ones(256)
            for place, letter in enumerate(reversed(gram)):
                v = v * np.roll(made.letter(ord(letter)), place)
            total += count * v
        return total, sum(n.values())

    rows = [r for r in picked if not re.search(r"[^\x00-\x7fà-ÿÀ-ßß]", r["text"])]
    prototypes = {}
    for r in rows:
        v, n = profile(r["text"])
        prototypes[r["lang"]] = prototypes.get(r["lang"], 0) + v / n
    got = langid.fit_prototypes(some.where(F.col("doc_id").isin([r["doc_id"] for r in rows])), dimensions=256)
    for lang, v in prototypes.items():
        assert float(got[lang] @ (v / np.linalg.norm(v))) > 0.9999


def test_language_odd(spark, odd):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, langid.fit_prototypes(odd)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (7, "de"), (None, "fr")} <= got
    assert langid.fit_prototypes(odd.limit(0)) == {} and langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.identify_held_out(odd.limit(0)).count() == 0


def test_language_pieces_and_cancelled_profiles():
    """Counts do not depend on where a long text is cut; a text with letters whose profile is zero still gets a language."""
    r = random.Random(3)
    text = "".join(r.choice("abc  .1é中") for _ in range(500))
    whole = dict(zip(*map(np.ndarray.tolist, langid.ngrams(text)), strict=True))
    for piece in (1, 2, 3, 7, 64, 499, 500, 501):
        assert dict(zip(*map(np.ndarray.tolist, langid.ngrams(text, piece=piece)), strict=True)) == whole, piece
    assert not len(langid.ngrams("1 2 3" * 50, piece=4)[0]) and not len(langid.ngrams("")[0])
    predict = langid._predictor({"b": np.zeros(64), "a": np.zeros(64)}, 64, 3, 42)
    assert predict(["abc", "123", None]) == (["a", "und", "und"], [0.0, 0.0, 0.0])


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    return {i: root(i) for i in ids}


def test_simhash(docs, texts):
    prints = {i: plain_fingerprint(r["text"]) for i, r in texts.items()}
    want = plain_components(prints)
    for r in simhash.near_duplicates(docs).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_pigeonring_loses_no_link(spark, hot):
    """Chains of fingerprints at all distances around the budget, and a dense ball, link as brute force has it."""
    r = random.Random(9)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    middle = r.getrandbits(64)
    values |= {middle ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    want = plain_components({v: v for v in values})
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(spark.createDataFrame(signed, "bits long"), hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    parent = {v: v for v in values}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert all((root(a) == root(b)) == (want[a] == want[b]) for a in values for b in r.sample(sorted(values), 20))


def test_hot_keys_count_flipped_members(spark):
    """A key with one member of its own beside a dense key is split on the flipped side, and nobody is lost."""
    rng = np.random.default_rng(6)
    dense = np.unique(rng.integers(0, 1 << 38, 3000)) << 26  # the first two segments are all zeros
    lone = int(dense[0]) | 1 << 13  # one bit of the second segment set: its own key is reached by every dense member
    df = spark.createDataFrame([(int(np.int64(v)),) for v in [*dense.astype(np.int64), lone]], "bits long")
    split = {r["key"]: r for r in simhash._hot_keys(df, simhash.WIDTHS, 512).collect()}
    assert split[1]["lefts"] == 1 and split[1]["rights"] >= 11 and split[0]["lefts"] >= 11
    edges = {tuple(r) for r in simhash.links(df, hot=512).collect()}
    assert (min(int(dense[0]), lone), max(int(dense[0]), lone)) in edges


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(30)] + [(500, 501), (501, 500), (700, 700)]
    parent = {v: v for e in edges for v in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent if v != 700 and any(v in e and e[0] != e[1] for e in edges)}


def test_simhash_odd(odd):
    got = simhash.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = left - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in free)
        target = {s: most * sizes[s] for s in capped} | {s: rest * weight[s] / total for s in free}
        if not (over := {s for s in free if target[s] > most * sizes[s]}):
            return target
        capped |= over


def test_mixing(spark):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        s = r.choice(["a", "a", "a", "a", "b", "c", "é", None])
        rows.append((i, "w " * (0 if i % 97 == 0 else int(r.paretovariate(1.1) * 20)), s))
    rows += [(5000, "few words", "tiny"), (5001, None, "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, together=200).collect()
    again = {(x["doc_id"], x["taken"]) for x in mixing.mix(df.repartition(7), together=200).collect()}
    source = {i: s for i, _, s in rows}
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x["size"] == len((dict((i, t) for i, t, _ in rows[-2:]).get(x["doc_id"]) or next(t for i, t, _ in rows if i == x["doc_id"]) or "").split()) if x["doc_id"] >= 5000 else True
        assert 0 <= x["taken"] <= 3 * x["size"]
        sizes[source[x["doc_id"]]] += x["size"]
        taken[source[x["doc_id"]]] += x["taken"]
    want = plain_targets(dict(sizes) | {s: 0 for s in source.values() if s not in sizes})
    for x in got:
        assert math.isclose(x["target"], want[source[x["doc_id"]]], rel_tol=1e-9, abs_tol=1e-9) and x["source_size"] == sizes[source[x["doc_id"]]]
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in want)
    assert again == {(x["doc_id"], x["taken"]) for x in got}


def test_mixing_odd(odd):
    got = mixing.mix(odd).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len((t or "").encode().split())) for i, t, *_ in ODD)
    assert all(0 <= x["taken"] <= 3 * x["size"] for x in got)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_hot_rows_and_reruns(spark):
    """Null ids of one size, however many, are one entry; reruns agree whatever the partitions; sums of any size are exact."""
    rows = [(None, "a b c d e", "s")] * 9000 + [(i, "w " * (1 + i % 50), "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter(map(tuple, mixing.mix(df.repartition(n), together=50).collect())) for n in (3, 8)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)
    taken = sum(n * x[5] for x, n in runs[0].items() if x[0] is None)
    target = next(x[3] for x in runs[0] if x[0] is None)
    assert abs(taken - target) <= 5
    big = spark.createDataFrame([("s", 10**9 + i, 10**6) for i in range(40)], "mix_source string, size long, docs long")
    targets = spark.createDataFrame([("s", 4 * 10**16, 4 * 10**7, 10**16 + 0.5)], "mix_source string, source_size long, sized long, target double")
    found = [mixing.balance(big.repartition(n), targets).first()["multiplier"] for n in (2, 7)]
    assert found[0] == found[1]


def test_mixing_places_sources_without_one_task(spark):
    names = [None if i == 7 else f"s{i * 7919 % 1000:03d}é" for i in range(60)]
    placed = mixing._placed(spark.createDataFrame([(n, 1) for n in names], "mix_source string, source_size long").repartition(9))
    assert [r["mix_source"] for r in placed.orderBy("place").collect()] == sorted(names, key=lambda n: (n is None, n or ""))
    assert [r["place"] for r in placed.orderBy("place").collect()] == list(range(60))


def test_copies_of_entries_are_those_of_their_documents():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 60, 40))[::-1]
    counts, rates = rng.integers(1, 9, 40), rng.uniform(0, 3, 40)
    copies, more = mixing.copies_of(sizes, rates, 3, counts)
    expected = float((sizes * rates * counts).sum())
    assert abs(float((sizes * (copies * counts + more)).sum()) - expected) <= sizes.min() / 2 + 1
    assert (copies >= 0).all() and (copies + (more > 0) <= 3).all() and (more < counts).all()
