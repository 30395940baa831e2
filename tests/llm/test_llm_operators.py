"""The training-data operators against plain versions, and on odd input."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import plain
from conftest import SMALL
from loanstrata.llm import bpe, components, decontaminate, hosts, jaccard, katz, language, shards, substring, vectors, warc
from loanstrata.llm.queries import QUERIES

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return plain.with_clashes(plain.documents(spark, plain.odd_rows()))


@pytest.fixture(scope="module")
def none(spark):
    return plain.documents(spark, [])


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def unique(rows):
    return list({r[0]: r for r in rows}.values())


# --- vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(scale=0.05, size=(10, 16)), np.repeat(base[:1], 5, 0),
                        base[1] + rng.normal(scale=0.03, size=(60, 16))]).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16),
           (905, [float("inf")] * 16), (906, [1.0] * 8), (907, [2.0] * 8), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1)).withColumn("list", F.lit("a"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    y = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    lead = plain.roots([tuple(map(int, p)) for p in np.argwhere(near)], range(len(y)))
    for i in range(len(y)):
        assert got[i] == (near[i].sum(), lead[i], lead[i] == i)
    for i in range(900, 906):
        assert got[i] == (0, i, True)
    assert got[906] == (1, 906, True) and got[907] == (1, 906, False) and got[None][0] == 0
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_any_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vectors.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


# --- language model


def test_katz_matches_plain_version(spark, table):
    docs, rows = table
    held_out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want, sums, n = plain.katz(rows, held_out)
    got = {r.doc_id: r for r in katz.score_documents(docs).collect()}
    assert set(got) == set(want)
    for d, (tokens, known, base, score) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held_out(d))
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
    assert all(s == pytest.approx(1, abs=1e-9) for s in sums.values())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_spreads_hot_histories(spark, table, monkeypatch):
    docs, rows = table
    rows_of = docs.select("doc_id", "text", (~katz.in_fold()).alias("train"))
    hot = katz.hot_histories(rows_of, 61)
    assert len(hot) and katz.BEGIN not in hot or len(hot) <= katz.HOT_PER_BUCKET * 61
    # With none spread, and with nearly every repeated word spread, the scores are the same.
    found = []
    for share in (1e-9, 1e9):
        monkeypatch.setattr(katz, "HOT_PER_BUCKET", share)
        found.append({r.doc_id: (r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score_documents(docs).collect()})
    assert found[0] == found[1]


def test_katz_on_odd_rows(odd, none, spark):
    got = {r.doc_id: r for r in katz.score_documents(odd).collect()}
    assert len(got) == 18 and got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1
    assert got[14].n_tokens == 60_002 and all(np.isfinite([r.score, r.base_score]).all() for r in got.values())
    assert katz.score_documents(none).count() == 0
    lone = katz.score_documents(plain.documents(spark, [(1, "a b")]), F.lit(True)).collect()[0]
    assert (lone.n_known, lone.train_tokens, lone.base_score, lone.score) == (0, 0, 0.0, 0.0)
    assert katz.score_documents(plain.documents(spark, [(None, "a")])).collect()[0].doc_id is None


def test_discounts_stay_inside():
    for n in ([0] * 6, [1] * 6, [5, 4, 3, 2, 1, 0], [1000, 300, 120, 60, 40, 25]):
        d = katz.discounts(n)
        assert all(0 < x < 1 for x in d[1:-1]) and d[-1] == 1


def test_squeezed_numbers_come_back():
    for values in ([], [0], [255], [256, 0], [1] * 500, range(1000), [2**64 - 1, 3]):
        whole = np.array(list(values), np.uint64)
        assert katz.unsqueeze(katz.squeeze(whole)).tolist() == whole.tolist()
    assert len(katz.squeeze(np.ones(500, np.int64))) < 60


# --- decontamination


def test_decontamination_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, plain.PASSAGE), (2, "gamma1 gamma2 gamma3"), (3, None), (4, ""), (5, "two words"),
                                   (6, "日本語"), (6, "日本語"), (7, "absent thing")], ITEMS).withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == plain.contaminated(unique(plain.odd_rows()), [(i, t) for i, t in items.dropDuplicates(["item_id"]).select("item_id", "text").collect()])
    assert (9, 1) in got and (10, 1) in got and (6, 5) in got
    assert decontaminate.contaminated(none, items).count() == 0 == decontaminate.contaminated(odd, items.limit(0)).count()
    kept = decontaminate.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({d for d, _ in got})


def test_signature_loses_nothing(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 60)], ITEMS)
    docs = plain.documents(spark, [(i, " ".join([*["z"] * 300, *words[a:b], *["y"] * 300])) for i, (a, b) in enumerate(
        (a, b) for a in range(0, 20, 3) for b in range(a + 1, 61, 4))])
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == plain.contaminated(rows, [tuple(r) for r in items.collect()])


# --- hosts


def test_rules_and_urls(spark):
    urls = [("HTTP://A.Example.ORG/es/x?q=1#z", "a.example.org", "/es/x", "example.org/es/", "block"), (None, "", "", None, "allow"),
            ("no scheme", "", "", None, "allow"), ("x://h://b/c", "h:", "//b/c", None, "allow"),
            ("a\nb://H.com/de/\n1?z", "h.com", "/de/\n1", "com/de/", "block"), ("http://org#frag/x", "org", "", None, "allow"),
            ("http://h.net/a#b?c", "h.net", "/a", None, "allow"), ("://com/fr/1", "com", "/fr/1", "com/fr/", "allow"),
            ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
            ("https://notorg/x", "notorg", "/x", None, "allow"), ("", "", "", None, "allow")]
    df = spark.createDataFrame([(i, u[0], None if i % 2 else "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(df.withColumn("host", F.lit(1)).withColumn("src", F.lit(2))).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert hosts.judge(df.limit(0)).count() == 0


def test_distrust_goes_to_hosts_that_link_to_blocked_ones(spark):
    bad, good, plain_host = "<a href='http://shop.com/x'>", "see www.fine.org", "nothing"
    rows = [(1, "http://shop.com/de/1", ""), (2, "http://links.net/a", bad), (3, "http://fine2.net/a", plain_host),
            (4, "http://www.fine.org/a", "mentions fine2.net and links.net"), (5, "http://far.net/", "links.net"), (6, "http://links.net/b", good)]
    got = {r.page_id: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].verdict == "allow" and got[3].trust > 0 and got[3].distrust == 0
    assert got[5].verdict == "block" and got[5].distrust > got[5].trust == 0
    assert got[2].distrust > 0 and got[2].trust > 0


def test_propagation_reaches_its_limit(spark):
    rng = np.random.default_rng(1)
    w = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    p = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{j}", float(p[i, j])) for i, j in np.argwhere(p > 0)], "kind string, src string, dst string, p double")
    seeds = spark.createDataFrame([("trust", "h0", 0.7), ("trust", "h3", 0.3)], "kind string, host string, seed double")
    got = {r.host: r["rank"] for r in hosts.propagate(edges, seeds).collect()}
    rank = 0.15 * np.linalg.solve(np.eye(6) - 0.85 * p.T, np.array([0.7, 0, 0, 0.3, 0, 0]))
    assert all(got.get(f"h{i}", 0.0) == pytest.approx(rank[i], abs=1e-6) for i in range(6))


PAGES = "page_id long, url string, html string"


def test_distrust_follows_a_chain_of_thirty_hosts(spark):
    rows = [(0, "http://h0.com/de/", "")] + [(i, f"http://h{i}.net/a", f"<a href='http://h{i - 1}.{'com' if i == 1 else 'net'}/'>") for i in range(1, 31)]
    got = {r.page_id: r for r in hosts.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(r.verdict == "block" for r in got.values())
    assert got[30].distrust == pytest.approx(0.15 * 0.85 ** 30, abs=1e-7)


def test_links_hold_any_host(spark):
    links = {"h.com:8080": '<a href="http://H.com:8080/x">', "me@h.com": "see http://me@h.com?q", "under_score.com": "<a href='//under_score.com'>",
             "localhost.com": "(http://LOCALHOST.com)", "bücher.com": "<img src=https://bücher.com/a.png>", "a b.com": '<a href="http://a b.com/">',
             "intranet": "http://intranet"}
    rules = [hosts.Rule("block", host, "/de/") for host in links]
    rows = [(i, f"http://{host}/de/", "") for i, host in enumerate(links)] + [(10 + i, f"http://x{i}.net/", link) for i, link in enumerate(links.values())]
    got = {r.page_id: r.verdict for r in hosts.judge(spark.createDataFrame([*rows, (99, "http://y.net/", "an intranet")], PAGES), rules).collect()}
    assert {page for page, verdict in got.items() if verdict == "allow"} == {99}


def test_verdicts_of_the_whole_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = plain.judged([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages).collect()}
    assert got == want


# --- byte-level BPE


def test_bpe_equals_tiktoken(spark, odd, none, table):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(100, "a" * 3000), (101, "<|endoftext|> <unk> <s> ▁▁ Ġ"), (102, "".join(map(chr, range(1, 3000))))]
    docs = odd.select("doc_id", "text", "h").unionByName(plain.documents(spark, extra).select("doc_id", "text", F.lit("x").alias("h")))
    texts = dict([*plain.odd_rows(), *extra])
    for r in bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        want = other.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == plain.sha(",".join(map(str, want))) and r.decoded_sha256 == plain.sha(text)
    assert bpe.encode_documents(none, ranks, public_tokenizers.PATTERN).count() == 0


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/", big), (2, "http://b/ x\r\nEvil: 1", big), (3, None, "small"), (4, "http://d", "small"), (5, "http://e", None),
            (6, "http://f", ""), (7, "http://g", "x\r\n\r\ny\0z" * 200), (2, "http://b2/", big), (8, "http://h", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_key", F.lit(1)).withColumn("refers_to", F.lit(9))
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_archives(spark, folder, True).collect())
    assert len(got) == 9
    for page, kind, refers, size, payload in got:
        html = ([h or "" for p, _, h in rows if p == page][0]).encode()
        assert size == len(html) and (kind, refers) == (("revisit", 2) if page == 1 else ("response", None))
        assert payload == (None if page == 1 else bytearray(html) if isinstance(payload, bytearray) else html)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_keeps_null_ids_apart_from_minus_one(spark, tmp_path):
    big = "same " * 400
    pages = spark.createDataFrame([(None, "u", big), (-1, "v", big), (-3, "w", big), (None, None, None)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "n"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "n")).collect()), key=str)
    assert got == [(-1, "response", None, 2000), (-3, "revisit", -1, 2000), (None, "response", None, 0), (None, "response", None, 2000)]


def test_warc_segments_and_damage(monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 100)
    parts = warc.members(7, "u", b"payload " * 50, None)
    assert len(parts) == 5 and all(p[-1] == 0 for p in parts)
    page = list(warc.pages_of(iter(warc.Reader(b"".join(parts)))))
    assert [(p[0], p[1], p[3], p[6]) for p in page] == [(7, 400, "response", b"payload " * 50)]
    whole = warc.members(7, "u", b"p" * 20, None)[0]
    with pytest.raises(ValueError):
        list(warc.Reader(whole[:-3]))
    import gzip
    bad = gzip.compress(gzip.decompress(whole).replace(b"pppp", b"ppqp", 1))
    with pytest.raises(ValueError, match="block digest"):
        list(warc.Reader(bad))


# --- substring dedup


def test_substring_matches_brute_force(odd, none, table):
    docs, rows = table
    for df, source in ((docs, rows), (odd, unique(plain.odd_rows()))):
        want = plain.removed(source, 20)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(df).collect()}
        assert got == {d: (len(w), len(g), plain.sha(" ".join(x for i, x in enumerate(w) if i not in g))) for d, (w, g) in want.items()}
    assert substring.removal_report(none).count() == 0


def test_removed_texts(odd):
    want = plain.removed(unique(plain.odd_rows()), 20)
    kept = substring.remove_repeats(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    texts = {r.doc_id: r for r in kept.collect()}
    assert not {8, 16} & set(texts) and not set(range(len(want[16][0]))) - want[16][1] and texts[1].text is None and texts[3].text == " \t\n\x0b "
    assert texts[9].text == "start end" and texts[9].n_chars == 9 and texts[7].text == plain.PASSAGE


def test_substring_with_null_and_shared_ids(spark):
    rows = [(None, plain.PASSAGE), (5, plain.PASSAGE), (5, plain.PASSAGE), (6, "a b c")]
    got = sorted(((r.doc_id is None, r.doc_id), r.n_removed) for r in substring.removal_report(plain.documents(spark, rows)).collect())
    assert [n for _, n in got] == [0, 0, 0, 60]


def test_packing_round_trips():
    doc, start = np.array([3, 3, 3, 9, 9], np.int64), np.array([0, 5, 70_000, 2, 3], np.int64)
    a, b = substring.ungrouped(*substring.grouped(doc, start))
    assert a.tolist() == doc.tolist() and b.tolist() == start.tolist()
    assert substring.intervals(np.array([1, 2, 21, 60]), 20) == [(1, 41), (60, 80)]


# --- language


def test_language_accuracy_and_rejects(spark, table, odd, none):
    docs, _ = table
    learned = language.fit(docs.where(~language.in_fold()))
    got = docs.join(language.predict(docs, learned), "doc_id").where(language.in_fold()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd_pred = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, learned).collect()}
    assert all(odd_pred[d] == ("und", 0.0) for d in (1, 2, 3, 15, 17)) and odd_pred[13][0] != "und"
    assert language.predict(none, learned).count() == 0
    assert {r.lang_pred for r in language.predict(odd, {}).collect()} == {"und"}
    kept = language.keep_known(odd, learned)
    assert kept.columns == odd.columns and {1, 2, 3, 15, 17}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language.keep_known(docs, learned).count() == docs.count()


def test_copies_do_not_thin_the_sample(spark):
    k = F.col("id")
    one = spark.range(100_000).select(k.alias("doc_id"), F.lit("uno dos tres cuatro cinco seis siete").alias("text"), F.lit("es").alias("lang"))
    few = spark.range(100_000).select(k.alias("doc_id"), F.concat(F.lit("eins zwei drei vier "), F.conv((k % 300).cast("string"), 10, 2)).alias("text"), F.lit("de").alias("lang"))
    rare = spark.range(3).select(k.alias("doc_id"), F.concat(F.lit("un deux trois quatre "), k.cast("string")).alias("text"), F.lit("fr").alias("lang"))
    learned = language.fit(one.unionByName(few).unionByName(rare))
    assert {lang: text.count(b"\n") for lang, text in learned.items()} == {"es": 1, "de": language.SAMPLE_ROWS, "fr": 3}
    got = {r.doc_id: r.lang_pred for r in language.predict(plain.documents(spark, [(1, "dos tres cuatro"), (2, "zwei drei"), (3, "deux trois")]), learned).collect()}
    assert got == {1: "es", 2: "de", 3: "fr"}


def test_sample_does_not_depend_on_the_cut(spark, table, monkeypatch):
    docs, _ = table
    want = language.fit(docs, 20)
    monkeypatch.setattr(language, "MARGIN", 0.05)
    assert language.fit(docs, 20) == want
    smallest = sorted((r["h"], r["text"]) for r in docs.where("lang = 'en' and text rlike '\\\\p{L}'").selectExpr("shiftrightunsigned(xxhash64(text), 1) AS h", "substring(text, 1, 3000) AS text").distinct().collect())
    assert want["en"] == "".join(t + "\n" for _, t in smallest[:20]).encode()[:language.SAMPLE_BYTES]


def test_every_language_is_learned(spark, monkeypatch):
    number = F.format_string("%03d", F.col("id") % 260)
    text = F.translate(number, "0123456789", "abcdefghij")
    docs = spark.range(520).select(F.concat(F.lit("l"), number).alias("lang"), F.concat(text, text, F.lit(" "), (F.col("id") >= 260).cast("string")).alias("text"))
    learned = language.fit(docs)
    assert len(learned) == 260 and sum(map(len, learned.values())) <= language.TOTAL_BYTES
    monkeypatch.setattr(language, "TOTAL_BYTES", 260 * 4)
    monkeypatch.setattr(language, "LEAST_BYTES", 4)
    assert {len(s) for s in language.fit(docs).values()} == {4}
    monkeypatch.setattr(language, "LEAST_BYTES", 5)
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)


def test_cross_parsing_matches_a_greedy_search():
    text = b"abracadabra abracadabra"
    model = language.Model({"a": text, "b": b"zzzz"})
    for sample in (b"abra", b"cadabrax", b"qqq", b"dabra abraz", b"a" * 700):
        counts, _ = model.phrases(pa.array([sample.decode()]))
        folded = language.symbols(np.frombuffer(sample, np.uint8)).tobytes()
        want, source = 0, language.symbols(np.frombuffer(text, np.uint8)).tobytes()
        for at in range(0, len(folded), language.SEGMENT):
            part = folded[at:at + language.SEGMENT]
            while part:
                n = max((k for k in range(1, len(part) + 1) if part[:k] in source), default=1)
                part, want = part[n:], want + 1
        assert abs(counts[0, 0] - want) <= -(-len(folded) // language.SEGMENT)


# --- Jaccard join


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard_matches_brute_force(spark, table, odd, none, size, num, den):
    docs, rows = table
    for df, source in ((docs, rows), (odd, unique(plain.odd_rows()))):
        want = plain.jaccard(source, size, num, den)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, num, den).collect()}
        assert got == want
    assert jaccard.jaccard_components(none, size, num, den).count() == 0


def test_jaccard_tiles_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(40 + 5 * g)]
        for k in range(25):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 3)):
                w[at] = f"r{g}{k}{at}"
            rows.append((g * 100 + k, " ".join(w[:len(w) - rng.integers(0, 4)])))
    want = plain.jaccard(rows, 3, 90, 100)
    monkeypatch.setattr(jaccard, "TASK_DOCS", 4)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    docs = plain.documents(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 3, 90, 100).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)
    kept = jaccard.keep_one(docs, 3, 90, 100)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_jaccard_with_null_id(spark):
    rows = [(None, plain.PASSAGE), (3, plain.PASSAGE), (2, plain.PASSAGE)]
    got = sorted(((r.doc_id or 0), r.component_id) for r in jaccard.jaccard_components(plain.documents(spark, rows), 3, 9, 10).collect())
    assert got == [(0, None), (2, 2), (3, 2)]


def test_components_of_paths_stars_and_repeats(spark):
    rng = np.random.default_rng(2)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    rest = [tuple(map(int, p)) for p in rng.integers(2000, 2400, (250, 2))]
    links = [*path, *star, *rest, *rest, (5, 5)]
    rng.shuffle(links)
    df = spark.createDataFrame([tuple(map(int, p)) for p in links] + [(None, 3)], "a long, b long").repartition(7)
    want = plain.roots(links, {n for p in links for n in p})
    got = {r.id: r.component for r in components.components(df, "a", "b").collect()}
    assert got == {n: c for n, c in want.items() if n != c}


# --- sharding


def test_shards_are_even_and_keep_equal_texts_together(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = shards.shard_documents(docs, 4).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    size = [sum(r["size"] for r in rows if r.shard == s) for s in range(4)]
    largest = max(len(t.encode()) for t in texts.values())
    assert max(size) - min(size) <= 2 * largest and sum(size) == sum(len(t.encode()) + 1 for t in texts.values())
    home = {}
    for r in rows:
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    few = shards.shard_documents(odd, 16).collect()
    assert len(few) == odd.count() and all(0 <= r.shard < 16 for r in few)
    assert {(r["size"], r.text_crc32) for r in few if r.doc_id == 1} == {(1, None)}
    assert shards.shard_documents(none, 16).count() == 0


def test_leaves_follow_the_target(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = sum(len(r.text.encode()) + 1 for r in docs.collect())
    assert len({r.shard for r in shards.shard_documents(docs, target_bytes=total // 5).collect()}) in (5, 6)


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
