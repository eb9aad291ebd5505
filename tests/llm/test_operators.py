"""The ten operators: SQL where it says the same, brute force elsewhere, and each edge case's defined result."""

import base64
import hashlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import database, same
from conftest import SF
from pyspark.sql import functions as F

from quillon.llm import common, components, decontaminate, encoding, exact, html_text, language, minhash, queries, repeats, sharding, token_counts, warc, words
from quillon.llm.bpe import WordBpe, read_vocabulary
from quillon.llm.common import string_buffers

VOCAB = public_tokenizers.path("word_bpe_49k.json")
FOLD = {i: i + 32 for i in range(65, 91)}
EDGES = [(1, "One two three four five six seven eight nine"), (2, None), (3, ""), (4, " \n\t "), (5, "!!!"), (6, "x" * 3000), (7, "long words " * 30000), (8, "ONE two three four five six seven eight nine"), (8, "ONE two three four five six seven eight nine"), (None, "one Two three four five six seven eight nine"), (9, "é 中文 ümlaut"), (10, "a\0b \x1f c")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    df = spark.createDataFrame(EDGES, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("size", "shard", "n", "row", "key", "range", "lang", "sha", "tokens", "__id", "__xx", "__lang", "__left0", "own_id", "GONE_ID", "gone_xx", "Lang_Pred", "score", "id", "xx", "a`b", "c.d")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(spark, database(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(docs, n, percent):
    """id -> smallest id of its component, over all pairs."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("small", "part", "block"), [(8, 256, 4096), (2, 7, 7), (8, 3, 5), (8, 1, 1)])
def test_minhash_by_brute_force(spark, small, part, block):
    """Near copies at all similarities, with hot buckets and groups over several tiles."""
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    docs = [(i, " ".join(w if r.random() > r.choice([0.0, 0.02, 0.05, 0.1]) else f"v{r.randrange(900)}" for w in base)) for i in range(70)]
    docs += [(100 + i, " ".join(f"u{r.randrange(400)}" for _ in range(r.randrange(1, 30)))) for i in range(60)] + [(200 + i, docs[i][1]) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), words=2, small_bucket=small, part_rows=part, block_rows=block).collect()
    assert {g["__id"]: g.component_id for g in got} == groups(docs, 2, 80)
    assert all(g.kept == (g["__id"] == g.component_id) for g in got)


def test_minhash_chain_over_parts(spark):
    """Each text is near its neighbours alone, so parts leave many groups; a second chain is loosely tied but apart."""
    docs = [(i, " ".join(f"w{k}" for k in range(i * 4, i * 4 + 50))) for i in range(40)]
    docs += [(100 + i, " ".join(f"x{k}" for k in range(i * 12, i * 12 + 50))) for i in range(12)]
    want = groups(docs, 2, 80)
    got = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), words=2, part_rows=4, block_rows=6).collect()
    assert {g["__id"]: g.component_id for g in got} == want and len(set(want.values())) > 1


def test_minhash_edges(spark, edges, empty):
    got = {(r["__id"], r.n_shingles): r for r in minhash.near_duplicates(edges, words=2).collect()}
    assert got[2, 0].component_id == 2 and got[3, 0].kept and got[4, 0].component_id == 4
    assert got[8, 8].component_id == 1 and not got[8, 8].kept and not got[None, 8].kept
    assert minhash.near_duplicates(empty).count() == 0
    left = minhash.drop_near_duplicates(edges, words=2)
    assert left.columns == edges.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10]


def test_odd_sketches_estimate():
    r = np.random.default_rng(1)
    sign = minhash.Signatures(48, 5)
    for j in (0.8, 0.9, 1.0):
        n = 1000
        same_ = int(2 * n * j / (1 + j))
        pool = words.mix(r.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        low = np.array([sign.samples(pool[:n]), sign.samples(np.r_[pool[:same_], pool[n : 2 * n - same_]])])
        a, b = sign.odd_sketches(low)
        assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= minhash.most_odd_bits(0.8, sign.k)


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 998), (5000, 5000), (None, 3)] + [(7000, 7001 + i) for i in range(300)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long").repartition(8), f"file://{tmp_path}/cc").collect()
    root = {r.node: r.root for r in got}
    assert all(root[i] == 0 for i in range(1, 201)) and root[1000] == root[999] == 998 and len([1 for x in root.values() if x == 7000]) == 300
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_words(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    from quillon.llm.common import string_buffers
    import pyarrow as pa

    texts = [t for _, t in EDGES] + ["Ab ab AB", "y" * 500 + " z"]
    for keep, pattern in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        lists = []
        for _, h, b, _, _ in words.WordHasher(keep).documents(*string_buffers(pa.array(texts))):
            lists += [h[x:y].tolist() for x, y in zip(b[:-1], b[1:], strict=True)]
        for t, h in zip(texts, lists, strict=True):
            w = re.findall(pattern, (t or "").translate(FOLD))
            assert len(w) == len(h) and all(seen.setdefault(a, b) == b for a, b in zip(w, h, strict=True))
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("how", [{}, {"max_filter_bits": 1 << 16, "bits_per_row": 1 << 14}])
def test_exact(spark, edges, empty, how):
    rows = exact.exact_duplicates(edges, **how).collect()
    by = {}
    for r in rows:
        by.setdefault(r["__id"], []).append(r)
    assert len(rows) == len(EDGES)
    assert [r.kept for r in by[8]] == [True, True] and sorted(r.first for r in by[8]) == [False, True] and by[1][0].keep_id == 8 and by[1][0].group_size == 4
    assert by[2][0].keep_id == 3 and not by[2][0].kept and bytes(by[3][0].sha).hex() == hashlib.sha256(b"").hexdigest() and not by[None][0].kept
    assert exact.exact_duplicates(empty, **how).count() == 0
    left = exact.drop_exact_duplicates(edges, **how)
    assert left.columns == edges.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 8, 9, 10]


def test_shards(spark, edges, empty):
    rows = sharding.balanced_shards(edges, 3).collect()
    assert len(rows) == len(EDGES) and {r.text_crc32 for r in rows if r["__id"] == 2} == {0} and {r.size for r in rows if r["__id"] == 2} == {16}
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.balanced_shards(empty, 3).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))
    got = sharding.balanced_shards(many, 40).groupBy("shard").agg(F.sum("size").alias("b"), F.min("__id").alias("lo"), F.max("__id").alias("hi")).orderBy("shard").collect()
    assert len(got) == 40 and max(r.b for r in got) - min(r.b for r in got) <= 2 * 114 and all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False))
    assert sum(r.b for r in got) == 5000 * 16 + 2 * sum(i % 50 for i in range(5000))


@pytest.mark.parametrize(("size", "bits"), [(16 << 20, 1 << 28), (60, 1 << 28), (60, 64)])
def test_decontaminate(spark, edges, empty, size, bits):
    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20))), (2, "Seven, eight; NINE!"), (3, None), (4, ""), (5, "中文"), (None, "words long words")], "item_id long, text string")
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame([(20, " ".join(["x"] * 300 + [f"t{i}" for i in range(3, 18)])), (21, " ".join(f"t{i}" for i in range(12)))], SCHEMA))
    rows = {r["id"]: r for r in decontaminate.benchmark_hits(docs, bench, max_automaton_bytes=size, max_map_bits=bits).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1]["items"]) == (9, 3, ["2"]) and rows[2].n_words == rows[3].n_words == 0
    assert rows[20].n_hit == 15 and rows[20]["items"] == ["1"] and rows[21].n_hit == 0 and rows[9]["items"] == ["5"] and rows[9].n_hit == 1
    assert rows[7].n_hit == 59999 and rows[7]["items"] == [""]
    left = decontaminate.drop_contaminated(docs, bench, max_automaton_bytes=size, max_map_bits=bits)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6, 10, 20, 21]
    cut = {r.id: r for r in decontaminate.remove_spans(docs, bench, min_span=13, max_coverage=0.5).collect()}
    assert cut[20].n_removed == 15 and cut[20].text.strip() == " ".join(["x"] * 300) and cut[7].dropped and cut[7].text is None and cut[21].text.endswith("t11")
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    none = decontaminate.benchmark_hits(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0


def test_repeats(spark, edges, empty):
    rows = {r["id"]: r for r in repeats.without_repeats(edges, min_words=1).collect()}
    assert rows[None].n_removed == 0 and rows[1].n_removed == 1 and rows[1]["text"] == "" and rows[2]["text"] is None and rows[2].n_units == rows[3].n_units == rows[4].n_units == 0 and rows[4]["text"] == " \n\t "
    assert rows[8].n_removed == 1 and rows[6].n_removed == rows[7].n_removed == 0 and rows[1].n_words_repeated == rows[None].n_words_repeated == 9
    line = "this line has more than eight words in it"
    docs = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"é\n  THIS line has more than eight\twords in it \nc"), (3, "a\nb\nc"), (4, line), (4, line)], SCHEMA)
    got = {r["id"]: r for r in repeats.without_repeats(docs, min_words=8, min_chars=1000).collect()}
    assert got[1].n_removed == 0 and got[2]["text"] == "é\n  c" and got[3].n_removed == 0 and got[4].n_removed == 1
    r = got[2].removed[0]
    assert "é\n  THIS line has more than eight\twords in it \nc"[r.start : r.end] == "THIS line has more than eight\twords in it"
    assert repeats.without_repeats(empty).count() == 0
    lines = {r["id"]: r for r in repeats.without_repeats(spark.createDataFrame([(1, "One. Two.\nx"), (2, "Two.\nOne. Two.\ny")], SCHEMA), min_words=2, sentences=False).collect()}
    assert lines[2]["text"] == "Two.\ny" and lines[1].n_units == 2


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_long_unspaced_lines_and_malformed_bytes(spark, monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    docs = spark.createDataFrame([(1, "中" * 250 + "\na"), (2, "b\n" + "中" * 250)], SCHEMA)
    got = {r["id"]: r for r in repeats.without_repeats(docs).collect()}
    assert got[1].n_removed == 0 and got[2]["text"] == "b\n" and [tuple(x) for x in got[2].removed] == [(2, 252)]
    units = repeats.Units(True)
    raw, off = string_buffers(pa.array(["one. two\nthree four! five", "", "\n one.\n", "x " * 200]))
    assert sum(len(row) for _, row, *_ in units.documents(raw, off)) == 6
    bad = docs.select("doc_id", F.concat(F.lit(b"\xff\n"), F.encode("text", "UTF-8")).cast("string").alias("text"))
    assert {r["id"]: r.n_removed for r in repeats.without_repeats(bad).select("id", "n_removed").collect()} == {1: 0, 2: 1}


def test_passages_by_brute_force(spark):
    """Passages of over 50 words begin within lines of other texts: all but the first text that has one lose it, clean texts nothing."""
    r = random.Random(11)
    sentence = lambda v, n: " ".join(f"{v}{r.randrange(4000)}" for _ in range(n)) + "."
    passages = [" ".join(sentence("p", r.randint(4, 12)) for _ in range(9)) for _ in range(5)]
    docs = []
    for i in range(120):
        body = [sentence("w", r.randint(3, 15)) for _ in range(20)]
        body[r.randrange(20)] = "A common line that stands in many of the texts."
        text = "".join(x + r.choice([" ", "\n"]) for x in body)
        cut = r.choice([k for k, c in enumerate(text) if c == " "])
        docs.append((i, text if i % 3 else text[:cut] + " " + passages[i % 5] + text[cut:]))
    got = {x["id"]: x for x in repeats.without_repeats(spark.createDataFrame(docs, SCHEMA)).collect()}
    seen = set()
    for i, text in docs:
        if i % 3:
            assert got[i]["text"] == text and got[i].n_words_repeated == 0
            continue
        again = i % 5 in seen
        seen.add(i % 5)
        assert (got[i].n_removed >= 7) == again and got[i].n_words_repeated > 25
        tail = passages[i % 5].split(". ", 1)[1]
        assert (tail in got[i]["text"]) != again
        spans = got[i].removed
        assert not again or (len(spans) == 1 and tail in text[spans[0].start : spans[0].end])


def test_all_repeats_by_brute_force(spark):
    """With one word every repeated line goes; the first in id order stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["id"]: r for r in repeats.without_repeats(docs, min_words=1, sentences=False).collect()}
    seen = set()
    for r in docs.orderBy("doc_id").collect():
        keys = [k for k in (" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.translate(FOLD))) for x in r.text.split("\n")) if k]
        kept = [k for j, k in enumerate(keys) if k not in seen and k not in keys[:j]]
        seen.update(keys)
        left = [k for k in (" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.translate(FOLD))) for x in got[r.doc_id]["text"].split("\n")) if k]
        assert left == kept and got[r.doc_id].n_removed == len(keys) - len(kept)


def test_language(spark, edges, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    p = language.learn(docs.where(~held))
    got = language.predict(docs.where(held), p, [F.col("lang")]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    rows = {r.doc_id: r for r in language.predict(edges, p, [F.col("doc_id")]).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 5)) and rows[1].lang_pred == "en" and 0 < rows[9].score <= 1
    nothing = language.learn(empty.withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language.predict(edges, nothing, [F.col("doc_id")]).collect()} == {"und"}
    assert language.predict(empty, p, [F.col("doc_id")]).count() == 0
    with pytest.raises(ValueError, match="languages"):
        language.learn(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), max_languages=1)


def test_language_by_brute_force(spark):
    """Every prediction and score of the query, from bundles that are added up trigram by trigram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    b = language.Bundler()

    def bundle(text):
        clean = " " + " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()) + " "
        total = np.zeros(language.DIM)
        for (x, y, z), n in Counter(t for t in zip(clean, clean[1:], clean[2:], strict=False) if t[1] != " ").items():
            total += n * b.vector(ord(x) << 42 | ord(y) << 21 | ord(z)).astype(int)
        return total

    bundles = {r.doc_id: bundle(r.text) for r in docs}
    sums = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sums[r.lang] = sums.get(r.lang, 0) + bundles[r.doc_id]
    names = sorted(sums)
    units = np.array([sums[x] / np.linalg.norm(sums[x]) for x in names])
    for r in queries.QUERIES["op8_language"](spark, SF).collect():
        cos = units @ bundles[r.doc_id] / np.linalg.norm(bundles[r.doc_id])
        assert r.lang_pred == names[int(cos.argmax())] and abs(r.score - cos.max()) < 1e-5 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_repeated_rows_get_equal_results(spark, edges):
    p = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    same_ = [tuple(r) for r in language.predict(edges, p, [F.col("doc_id")]).collect() if r.doc_id == 8]
    assert len(same_) == 2 and len(set(same_)) == 1 and same_[0][1] == "en"
    ids = [tuple(r) for r in encoding.encoding_digests(edges, VOCAB).collect() if r[0] == 8]
    assert len(ids) == 2 and len(set(ids)) == 1 and ids[0][1] == 9


def test_pipeline_at_edges(spark, edges, empty, tmp_path):
    """Nulls, repeated rows, clashing names and no rows at all go through every stage."""
    import corpus_pipeline

    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20))), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = edges.drop("lang").withColumn("lang", F.lit("en"))
    dirty = docs.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(" ".join(f"t{i}" for i in range(30))))
    docs = docs.unionByName(dirty)
    wide = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, wide, str(tmp_path))
        if name != "encode":
            assert after.columns == wide.columns
        after.write.parquet(f"{tmp_path}/{name}")
        wide = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(r.doc_id for r in wide.collect()) == [6, 7, 8, 9, 10]
    none = empty.withColumn("lang", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


def test_language_bundles(monkeypatch):
    """Tables, pieces and any alphabet give the sum of the trigrams' vectors."""
    text = "Zażółć gęślą 中文字 abc, abc! " * 40

    def brute(b):
        clean = " " + " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()) + " "
        return sum(b.vector(ord(x) << 42 | ord(y) << 21 | ord(z)).astype(int) for x, y, z in zip(clean, clean[1:], clean[2:], strict=False) if y != " ")

    for alphabet, chars in ((160, 400_000), (6, 400_000), (160, 97)):
        monkeypatch.setattr(language, "ALPHABET", alphabet)
        monkeypatch.setattr(language, "RUN_CHARS", chars)
        b = language.Bundler()
        total = np.zeros(language.DIM)
        for _, (rows, extra) in b.counted([text]):
            total += b.table[rows].sum(0)
            total += b.bundle(*np.unique(extra, return_counts=True)) if len(extra) else 0
        assert (total == brute(b)).all()


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(read_vocabulary(VOCAB))


def samples():
    r = random.Random(3)
    made = ["".join(r.choice("abcdeést'lv 1<|>\n$%Ωϊçİß") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    return made + ["<|endoftext|>a <|startoftext|>", "A<|ENDOFTEXT|>", "'S'T don't''s é ΑΣ ΣΑΣ. ǅ ŉ ﬁ", "x" * 300, "ab" * 500, "", "\x1c\x1f a\x85b\xa0c", "Ᲊ ᲊ ՘", *[t or "" for _, t in EDGES[:6]]]


def test_bpe_is_the_library(bpe):
    from tokenizers import Tokenizer

    lib, enc, fst = Tokenizer.from_file(VOCAB), encoding.Encoder(bpe), token_counts.Transducer(bpe)
    for t in samples():
        want = lib.encode(t, add_special_tokens=False).ids
        ids, text = enc.both(t)
        assert np.frombuffer(ids, "<u4").tolist() == want and enc.encode(t) == ids
        assert text == enc.decode(ids) == lib.decode(want, skip_special_tokens=False)
        assert fst.counts([t]) == [len(want)]


def test_chunk_maps_compose(bpe):
    """Chunks of any length give the library's count, wherever they cut words; maps compose associatively."""
    from tokenizers import Tokenizer

    lib, fst = Tokenizer.from_file(VOCAB), token_counts.Transducer(bpe)
    texts = [*samples()[:300], "x" * 5000, "abcdefgh" * 300 + " z"]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk in (1, 3, 17, 1000):
        assert fst.counts(texts, chunk) == want
    stream, bounds, _ = fst.symbols(["unbelievable thereabouts incomprehensibility", "q" * 40])
    for chunk in (2, 5):
        maps, upto = fst.chunk_maps(stream, bounds, chunk)
        assert any(len(m) > 1 for m in maps)
        for a, b, c in zip(maps, maps[1:], maps[2:], strict=False):
            left, right = (token_counts.compose(token_counts.compose(a, b), c), token_counts.compose(a, token_counts.compose(b, c)))
            assert left == right
        mine, total = maps[: upto[1]], {}
        for m, scanned in zip(mine, token_counts.prefix_scan(mine), strict=True):
            total = token_counts.compose(total, m) if total else m
            assert scanned == total


def test_tables_forget(bpe, monkeypatch):
    from quillon.llm.bpe import Memo

    m = Memo(len, 4)
    assert [m[x] for x in ("a", "bb", "ccc", "dddd", "a", "eeeee")] == [1, 2, 3, 4, 1, 5] and len(m) + len(m.old) <= 5
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 5)
    small, large = token_counts.Transducer(bpe), token_counts.Transducer(bpe)
    words_ = [f"word{i}ing" for i in range(50)]
    assert [small.counts([w]) for w in words_] == [[n] for n in large.counts(words_)] and small.known < large.known


def test_token_queries_at_edges(spark, edges, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCAB)
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = [(r.id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(edges, VOCAB).collect()]
    assert sorted(counts, key=str) == sorted([(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES], key=str)
    for r in encoding.encoded(edges, VOCAB).where("__id < 5").collect():
        ids = lib.encode(dict(EDGES)[r["__id"]] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    for r in queries.QUERIES["op10_bpe"](spark, SF).collect():
        text = lib.decode(lib.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    bad = spark.createDataFrame([(1, bytearray(b"ab\xff cd"))], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert token_counts.token_counts(bad, VOCAB).first().n_tokens == len(lib.encode("ab\ufffd cd", add_special_tokens=False).ids) == encoding.encoding_digests(bad, VOCAB).first().n_tokens
    assert token_counts.token_counts(empty, VOCAB).count() == encoding.encoding_digests(empty, VOCAB).count() == 0


def test_decoded_texts_come_from_decode(monkeypatch):
    enc = encoding.encoder(read_vocabulary(VOCAB))
    monkeypatch.setattr(encoding.Encoder, "decode", lambda self, ids: f"{len(ids)} bytes")
    ids, text = enc.both("One word, and another.")
    assert text == f"{len(ids)} bytes"


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.loads(read_vocabulary(VOCAB))
    spec["model"]["end_of_word_suffix"] = None
    with pytest.raises(ValueError, match="word ends"):
        WordBpe(json.dumps(spec).encode())


def few(html):
    """The text of a page that is its host's only one."""
    return "\n".join(t for t, _, flag in html_text.read_page(html)[0] if not flag)


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use</div>{}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(("html", "want"), [
    (PAGE.format("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five<aside>no</aside><script>var a='</p>';</script></article>"), "A & B\none two three four\nfive"),
    (PAGE.format("<main><p>x<b>y</b>z</main>"), "xyz"),
    (PAGE.format("<div class='content with-sidebar'><p>kept</p><section id=comments><p>gone</p></section></div>"), "kept"),
    ("plain &lt;text&gt;", "plain <text>"), ("", ""), (None, ""), ("<script>", ""), ("<p>a<!-- b --><p hidden>c", "a"), ("<p>a < b", "a < b"), ("<a b='", "<a b='"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>c<td>d</table><form>f</form><div class=share>s</div></article>", "1\n2\nc\nd"),
    ("<article>" + "<b>" * 3000 + "deep" + "</article>", "deep"),
])
def test_page(html, want):
    assert few(html or "") == want


@pytest.mark.parametrize(("html", "want"), [
    ("<script>for(i=0;i<n;i++){x()}</script><p>Text</p>", "Text"), ("<p>a</p><SCRIPT>if(a<b)'</p>'</script ><p>b", "a\nb"),
    ("<style>a<b</styled></STYLE\n><p>c", "c"), ("<p>d<script>x<y</p>", "d"), ("<title>a<b</title>e", "e"),
])
def test_scripts_end_at_their_own_tag(html, want):
    assert few(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<body><div class='container sidebar-right'><article><p>a</article><div>b</div></div>", "a"), ("<div id='page' class='header-fixed'><main><p>a</main></div><p>b", "a"),
    ("<div class='post share-enabled'><article><p>a</article></div>", "a"), ("<div class='post share-enabled'><p>a</div>", "a"),
    ("<article><div class='article-header'><h1>T</h1><p>lede</div><p>a<div class=share><p>s</div></article>", "T\nlede\na"), ("<article><div class=banner><h1>T</h1></div><p>a</article>", "T\na"),
    ("<div class=content><p>long text of the page</div><div class=related><article><p>other</article></div>", "long text of the page"), ("<div class=main-menu><p>links links</div><p>a", "a"),
])
def test_marks_around_the_article(html, want):
    assert few(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<article><p class='social-science'>One</p><h2 id='comments-on-theory'>Two</h2><section id='share-of-market'><p>Three</p></section><p>Four</p></article>", "One\nTwo\nThree\nFour"),
    ("<body><header>Site name</header><p>text</p><footer>x</footer></body>", "text"), ("<article><header>by one</header><p>a</article>", "a"),
    ("<article>a</article><p>x<article>bb bb</article>", "a\nbb bb"), ("<article><p>a<div id=comments>b</div><article class=comment>c</article></article>", "a"),
])
def test_names_and_articles(html, want):
    assert few(html) == want


@pytest.mark.parametrize("html", ["<div>" * 200_000 + "x", "<div>y" * 50_000 + "</b></p>" * 50_000, "<div><li>y" * 50_000, "<li>" + "<div>y<p><b>" * 50_000])
def test_long_and_deep_pages_are_read_in_linear_time(html):
    from time import process_time

    read = []
    for part in (html[: len(html) // 4], html):
        began = process_time()
        found = html_text.read_page(part)
        read.append((process_time() - began, len(found[0]) + len(found[1])))
    assert read[1][0] < 8 * read[0][0] + 0.5 and read[1][0] < 10


def test_counts_decide_on_hosts_with_enough_pages(spark):
    """There no class is asked, nor the article element: what recurs goes, in its slot or as it is, the rest stays."""
    pages = [(i, f"http://many.example/{i}", f"<div class=x7>{'abcde'[i % 5]} teaser</div><p>text {i}</p><div class=alert>own {i}</div><article><p>more {i}</p></article><div><b>{i % 20} of all</b></div><span>{i}</span>") for i in range(60)]
    pages += [(100 + i, "http://few.example/", f"<p>text {i}</p><div class=alert>own {i}</div>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["id"]: r.text for r in html_text.main_text(df).collect()}
    assert got[7] == "text 7\nown 7\nmore 7\n7" and got[101] == "text 1"
    off = {r["id"]: r.text for r in html_text.main_text(df, min_pages=1000, slot_share=2.0).collect()}
    assert off[7] == "c teaser\ntext 7\nown 7\nmore 7\n7 of all\n7"  # without counts their text stays


def test_templates_go(spark):
    """A block that no mark tells from text goes where it recurs; text that recurs in an article stays."""
    pages = [(i, f"http://h.example/{i}", f"<body><div>buy our things</div><p>text {i}</p></body>") for i in range(8)]
    pages += [(20 + i, f"http://h.example/a{i}", f"<article><div>follow us now</div><p>same words</p><p>own {i}</p></article>") for i in range(8)]
    pages += [(40 + i, "http://copy.example/", "<article><div>all of it</div></article>") for i in range(9)]
    pages += [(60, None, None), (61, "::", ""), (62, "http://h.example/z", "<div>buy our things</div>"), (60, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("blocks", F.lit(1)).withColumn("host", F.lit("x"))
    rows = html_text.main_text(df).collect()
    got = {r["id"]: r.text for r in rows}
    assert len(rows) == len(pages) and got[3] == "text 3" and got[23] == "same words\nown 3" and got[40] == "all of it" and got[60] == got[61] == got[62] == ""
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_recurring_paragraphs_of_articles_go(spark):
    """Near copies of one article don't make its paragraphs template, nor does the same text outside of articles."""
    page = "<article><h1>T</h1><p>own words of page {0}, with some more of them</p><table><tr><td>see</table><ul><li>li {0}<li>Join us</ul><p>Read <b>more</b></p></article>"
    pages = [(i, f"http://h.example/{i}", page.format(i)) for i in range(20)]
    near = "<article><p>The longest paragraph of the article</p><p>and another one</p><p>dated {0}</p></article>"
    pages += [(100 + i, "http://near.example/", near.format(i)) for i in range(12)]
    pages += [(200 + i, "http://list.example/", f"<p>teaser of it</p><div>x {i}</div>") for i in range(9)] + [(220, "http://list.example/", "<article><p>teaser of it</p><p>all</p></article>")]
    got = {r["id"]: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[7] == "T\nown words of page 7, with some more of them\nli 7"
    assert got[105] == "The longest paragraph of the article\nand another one\ndated 5"
    assert got[203] == "x 3" and got[220] == "teaser of it\nall"


def test_templates_of_large_hosts_go(spark):
    """A block on a few hundredths of a large host's pages is template: at 400 the root is 20."""
    pages = [(i, f"http://h.example/{i}", f"<body><div>{'menu' if i < 20 else 'rare' if i < 39 else ''}</div><p>text {i}</p></body>") for i in range(400)]
    got = {r["id"]: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), slot_share=2.0).collect()}
    assert got[7] == "text 7" and got[30] == "rare\ntext 30" and got[50] == "text 50"


def test_pages_by_brute_force(spark):
    from html import unescape

    got = {r.page_id: r.text for r in queries.QUERIES["op1_html_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"</?(b|br)>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(1, "http://B.example/x?q=1", "<p>é"), (2, "http://a.example:8080/", None), (3, "", "<p>é"), (4, None, ""), (5, "http://[bad", "x" * 200_000), (5, "http://[bad", "x" * 200_000), (None, "http://b.example/x?q=1", "<p>é"), *[(100 + i, "http://hot.example/", f"{i}") for i in range(40)]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("offset", F.lit(1)).repartition(3)
    a = warc.write_archive(df)
    rows = a.read(a.look_up(a.captures)).collect()
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    assert len(rows) == len(pages)
    for i, _, h in set(pages):
        for r in (r for r in rows if r.page == i):
            raw = (h or "").encode()
            assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            response = best[h or ""] == i
            assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", best[h or ""])) and (not response or bytes(r.payload) == raw)
    index = warc.CaptureIndex(f"{a.folder}/index", a.files)
    for c in a.captures.collect():
        assert index.find(c.key, c.page, c.row) == list(c)
    assert index.find("zzz", 1, 1) is None and index.find("", None, -1) is None
    b = warc.write_archive(df, min_revisit_bytes=1 << 30)
    assert all(r.record_type == "response" for r in b.read(b.look_up(b.captures)).collect())
    e = warc.write_archive(df.limit(0))
    assert e.read(e.look_up(e.captures)).count() == 0
    bad = spark.createDataFrame([(1, "http://a.example/", bytearray(b"a\xff"))], "page_id long, url string, html binary").withColumn("html", F.col("html").cast("string"))
    c = warc.write_archive(bad)
    row = c.read(c.look_up(c.captures)).first()
    assert bytes(row.payload) == b"a\xff" and row.payload_digest == base64.b32encode(hashlib.sha1(b"a\xff").digest()).decode()
    n = len(a.read(a.look_up(a.captures), with_payload=False).rdd.glom().map(len).collect())
    assert n == a.tasks >= 4
    for uri in ("dbfs:/x", "wasbs://a@b/c", "oddfs://x/y"):
        with pytest.raises(ValueError, match="file system"):
            common.filesystem(uri)
    assert common.arrow_uri("s3a://b/k") == "s3://b/k" and common.arrow_uri("file:/x/y") == "file:///x/y"
    assert warc.url_key("http://www.Example.com:80/a?b") == "com,example,www)/a?b" and warc.url_key("https://e.org:8443") == "org,e:8443)/"


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(unicodedata.category(c)[0] == "L" for c in t)]
    last = {}
    for i, t in docs:
        last[t.translate(FOLD)] = max(i, last.get(t.translate(FOLD), i))
    docs = [(i, t) for i, t in docs if last[t.translate(FOLD)] == i]
    root = groups(docs, 5, 80)
    docs = [(i, t) for i, t in docs if root[i] == i]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    items = [find(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(0, len(w) - 12))}
    left = []
    for i, t in docs:
        w, hit = find(t), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            left.append((i, t))
    lib = Tokenizer.from_file(VOCAB)
    want = {i: hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in left}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert len(corpus_pipeline.STAGES) == 5
