"""Training-data operators against brute force, and their defined results on odd rows."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import byte_bpe, host_rules, html_main, mil_quality, minhash_dedup, packing, secrets, spotsigs, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, spans string, bucket string, n int"
WORDS = " ".join(f"word{k} and the other{k} was" for k in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, WORDS),
        (2, WORDS),
        (2, WORDS),
        (3, WORDS + " tail"),
        (4, None),
        (5, ""),
        (6, "   \n\t "),
        (7, "one"),
        (8, "one two"),
        (None, "a row without id"),
        (9, 'api_key = "abcdefghijkl123" AKIAABCDEFGHIJKLMN 0123456789abcdef0'),
        (10, "x" * 50_000 + " " + "é" * 3_000),
        (11, "The the the the the the"),
        (12, "a  b\n\n c   d 'tis it's 　wide"),
    ]
    return spark.createDataFrame([(i, t, "en", f"host{(i or 0) % 2}", 0, "x", "y", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_secrets(docs, empty):
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    r = got[9]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert r.spans.split(",")[0] == "assign:0:26" and got[4].spans == ""
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert secrets.digests(secrets.scan(empty)).count() == 0
    clean = {x.doc_id: x for x in secrets.redact(docs).collect()}
    assert clean[9].text == '[assign]" [access] [hex]' and clean[4].text is None and clean[9].n_chars == len(clean[9].text)


def test_random_strings_and_identifiers():
    enc = secrets.encoder(secrets.vocabulary())
    assert secrets.random_spans("key Zk3vQ9xT7bLm2Rw8Yp5Nc1Hd6 end", [], enc) == [(4, 3, 29)]
    for plain in ("some_long_identifier_name_here", "InternationalizationHelper", "d41d8cd98f00b204e9800998ecf8427e", "123456789012345678901234"):
        assert secrets.random_spans(plain, [], enc) == []


def test_minhash_matches_brute_force(spark, docs, empty):
    def sets(text, size=2):
        w = (text or "").encode().lower().split()
        return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()

    base = [f"alpha{k % 7} beta{k} gamma{k % 11}" for k in range(120)]
    near = [" ".join(base[:k] + [f"changed{k}"] + base[k + 1 :]) for k in range(60)]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate([*near, *(" ".join(base[: 100 + k]) for k in range(20))])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, sets(r.text)) for r in both.collect() if r.doc_id is not None]
    name = {i: i for i, _ in rows}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t) and find(i) != find(j):
                name[max(find(i), find(j))] = min(find(i), find(j))
    got = minhash_dedup.components(both, size=2).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), find(i)) for i, s in rows}
    assert len(got) == len(rows) + 1
    assert minhash_dedup.components(empty).count() == 0
    assert sorted(r.doc_id for r in minhash_dedup.keep_documents(docs).filter("doc_id < 4").collect()) == [1]


def test_random_strings_of_one_letter_case():
    enc = secrets.encoder(secrets.vocabulary())
    for secret in ("QZXVKJWPQMZXNVBLWQPLTRHD", "QZXVK-JWPQM-ZXNVB-LWQPL", "qzxvkjwpqmzxnvblwqpltrhd", "Zk3vQ9xT7bLm2Rw8", "QZXVKJWPQMZXNVBL"):
        assert secrets.random_spans(f"key {secret} end", [], enc) == [(4, 3, 4 + len(secret))]
        assert secrets.redacted(f"key {secret} end", enc) == "key [random] end"
    for plain in ("MAX_REQUEST_LENGTH_BYTES", "is-it-up-to-me-or-to-us", "internationalization", "snapshot-2024-01-02-final", "application/octet-stream"):
        assert secrets.random_spans(plain, [], enc) == []


def test_near_duplicates_keep_different_texts_of_one_id(spark):
    text = {k: " ".join(f"{k}{j}" for j in range(40)) for k in "abcdefg"}
    near = text["a"] + " tail"
    rows = [(1, text["a"]), (5, near), (5, text["b"]), (6, text["c"]), (6, text["d"]), (6, text["d"].upper()), (7, text["b"])]
    rows += [(None, text["e"]), (None, text["f"]), (None, text["f"]), (None, near), (8, text["g"]), (8, text["g"]), (9, None), (9, "")]
    wanted = [(1, text["a"]), (5, text["b"]), (6, text["c"]), (6, text["d"].upper()), (None, text["e"]), (None, text["f"]), (8, text["g"]), (9, None)]
    order = lambda found: sorted(found, key=str)
    for parts in (1, 3):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert order((r.doc_id, r.text) for r in minhash_dedup.keep_documents(table).collect()) == order(wanted)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    wanted = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, set()).add((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.array(wanted[r.doc_id], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(wanted[r.doc_id])
    assert all(sum(n for _, n in by_doc[i]) == len(ids) for i, ids in wanted.items())
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))}
    used = {}
    for lengths, n in packing.plan(counts):
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>same</p>"), (5, "http://b\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (7, "u", None), (8, "u", "é" * 1000), (5, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        warc.write(warc.page_records(pages), path, compression)
        got = {(r.record_id, r.record_type, r.refers_to, r.full_payload_bytes) for r in warc.read(spark, path).collect()}
        name = lambda page_id, payload: f"urn:x-page:{page_id}:{hashlib.sha1(payload.encode()).hexdigest()}"
        assert (name(1, "<p>same</p>"), "revisit", name(5, "<p>same</p>"), 11) in got and (name(7, ""), "response", None, 0) in got and len(got) == 6
        only = warc.read(spark, path).filter("record_type = 'response' AND record_id LIKE 'urn:x-page:8%'").collect()
        assert [bytes(r.payload).decode() for r in only] == ["é" * 1000]
        assert only[0].payload_digest == base64.b32encode(hashlib.sha1(("é" * 1000).encode()).digest()).decode()
    warc.write(warc.page_records(pages.limit(0)), f"{tmp_path}/none_at_all")
    assert warc.read(spark, f"{tmp_path}/none_at_all").count() == 0


def foreign(payloads: list[bytes], chunked: bool = False) -> list[bytes]:
    """Records as other writers write them."""
    out = [b"WARC/1.0\r\nwarc-type:warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: x\n\r\n\r\n"]
    for k, p in enumerate(payloads, 1):
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (b"Transfer-Encoding: chunked\r\n\r\n" if chunked else b"\r\n")
        block = head + (b"%x\r\n%s\r\n" % (len(p[:7]), p[:7]) + b"%X;x=y\r\n%s\r\n0\r\n\r\n" % (len(p[7:]), p[7:]) if chunked else p)
        out.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:%d>\r\nWARC-Target-URI: http://h/%d\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, k, len(block), block))
    return out


def test_warc_of_other_writers(spark, tmp_path):
    payloads = [b"<p>one page</p>", bytes(range(256)) * 3_000, b"eight by", b"\r\n\r\n and more"]
    for chunked in (False, True):
        records = foreign(payloads, chunked)
        for name, data in {"a.warc": b"".join(records), "b.warc.gz": b"".join(map(gzip.compress, records)), "c.warc.gz": gzip.compress(b"".join(records))}.items():
            folder = tmp_path / f"{name}-{chunked}"
            folder.mkdir()
            (folder / name).write_bytes(data)
            rows = {r.record_id: r for r in warc.read(spark, str(folder)).collect()}
            assert [bytes(rows[f"urn:uuid:{k}"].payload) for k in range(1, 5)] == payloads and bytes(rows["urn:uuid:0"].payload) == b"software: x\n"
            assert [(r.record_id, r.full_payload_bytes, r.payload) for r in warc.read(spark, str(folder), payload=False).filter("target_uri = 'http://h/3'").collect()] == [("urn:uuid:3", None, None)]
    own = warc.zipped(b"x" * 1000)
    assert gzip.decompress(own) == b"x" * 1000 and len(own) == warc.MEMBER_HEAD.unpack(own[: warc.MEMBER_HEAD.size])[-1]


def test_warc_revisits_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 60)) if rng.random() < 0.9 else None, "u", str(rng.choice(["", "a", "b", "c" * 50_000, f"own{k}"]))) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_own", F.lit("clash")).repartition(3)
    warc.write(warc.page_records(pages), str(tmp_path))
    warc.write(warc.page_records(pages.limit(0)), str(tmp_path))
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html] = max(i, largest.get(html, i))
    wanted = sorted((str(i), len(html), "revisit" if html in largest and (i is None or i < largest[html]) else "response") for i, _, html in rows)
    got = sorted((r.record_id.split(":")[2] or "None", r.full_payload_bytes, r.record_type) for r in warc.read(spark, str(tmp_path)).collect())
    assert got == wanted


def test_classifiers_learn_and_take_odd_rows(spark, docs, empty):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(60)) + (" dreadful" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, _, y in rows]) > 0.98
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(docs, empty.select("doc_id", F.lit(1).alias("toxic")))
    assert {round(r.score, 6) for r in toxicity.score(docs, nothing).collect()} == {toxicity.PRIOR}
    noisy = [(k, " ".join(f"###{j}" if k % 2 else f"plain{j}" for j in range(40)), int(k % 2 == 0)) for k in range(200)]
    table = spark.createDataFrame(noisy, "doc_id long, text string, quality int")
    model = mil_quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in mil_quality.score(table, model).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, _, y in noisy]) > 0.98
    assert mil_quality.score(docs, model).count() == docs.count() and mil_quality.score(empty, model).count() == 0


def test_byte_bpe_equals_the_library(spark, docs, empty, monkeypatch):
    enc = secrets.encoder(secrets.vocabulary())
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    long = ["a" * 5_000, "ab" * 1_000, " " * 3_000, "\n" * 300, "=" * 999, "aaab" * 100, "".join(rng.choice(list(letters), 4_000)), "".join(rng.choice(list("etaoinshr"), 2_000)), "漢字仮名交じり文" * 200, "é" * 700, "the" * 150, "1" * 2_500]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(long)] + [(200, long[0])], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).repartition(3)
    wanted = sorted((str(r.doc_id), r.text or "") for r in table.collect())
    for segment, block in ((300_000, 4_000_000), (20, 50)):
        monkeypatch.setattr(byte_bpe, "REMEMBERED", segment)
        monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", block)
        got = byte_bpe.encode(table).collect()
        assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got) == wanted
        for r in got:
            assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(bytes(r.decoded).decode())
    assert byte_bpe.encode(empty).count() == 0


def test_byte_bpe_of_many_places(spark):
    """Merges at many places in one step equal the plain merges, for a vocabulary with awkward ranks too."""
    rng = np.random.default_rng(4)
    awkward = {bytes([x]): x for x in range(256)} | {w.encode(): 256 + k for k, w in enumerate(["abc", "ab", "ba", "aa", "bab", "aab", "ca", "abab", "cab"])}
    words = ["ab" * 200, "aab" * 150, "abc" * 100, *("".join(rng.choice(list("abc"), 400)) for _ in range(20))]
    for ranks in (awkward, byte_bpe.read_ranks(secrets.vocabulary())):
        table = spark.createDataFrame([(k, [ranks[bytes([x])] for x in w.encode()]) for k, w in enumerate(words)], "k int, word array<long>")
        got = {r.k: r.ids for r in table.select("k", byte_bpe.encoded(F.col("word"), ranks).alias("ids")).collect()}
        assert got == {k: [ranks[p] for p in byte_bpe.merged(w.encode(), ranks)] for k, w in enumerate(words)}


def test_byte_bpe_of_short_words(spark):
    """Words of all lengths up to the bound and beyond it equal the plain merges; the rank map is flat, each pair in a place of its
    own, where it was 131,071 nested arrays that every task read anew."""
    rng = np.random.default_rng(5)
    awkward = {bytes([x]): x for x in range(256)} | {w.encode(): 256 + k for k, w in enumerate(["abc", "ab", "ba", "aa", "bab", "aab", "ca", "abab", "cab"])}
    words = ["".join(rng.choice(list(letters), n)) for n in range(1, byte_bpe.LONGEST + 3) for letters in ("abc", "etaoinshr dl", "é漢a")]
    for ranks in (awkward, byte_bpe.read_ranks(secrets.vocabulary())):
        table = spark.createDataFrame([(k, [ranks[bytes([x])] for x in w.encode()]) for k, w in enumerate(words)], "k int, word array<long>")
        got = {r.k: r.ids for r in table.select("k", byte_bpe.encoded(F.col("word"), ranks).alias("ids")).collect()}
        assert got == {k: [ranks[p] for p in byte_bpe.merged(w.encode(), ranks)] for k, w in enumerate(words)}
    steps, places, groups, size = byte_bpe.rank_map(awkward)
    assert [f.dataType.simpleString() for f in spark.range(1).select(steps, places).schema] == ["array<bigint>"] * 2
    keys = [a << 20 | b for a in range(300) for b in (0, 1, 7, 50_000)]
    shifts, held = byte_bpe.dealt(keys)
    assert all(held[(k + shifts[k % len(shifts)]) % len(held)] == k for k in keys) and len(held) - held.count(None) == len(keys) > len(held) // 3
    assert byte_bpe.dealt([])[1].count(None) == len(byte_bpe.dealt([])[1])


def test_spotsigs(docs, empty):
    rows = sorted(docs.dropDuplicates(["doc_id"]).collect(), key=lambda r: -(r.doc_id if r.doc_id is not None else -1))
    got = {r.doc_id: r for r in spotsigs.edits(docs.dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(text) // 2
        assert got[r.doc_id].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint and got[4].fingerprint == ""
    assert spotsigs.edits(docs).count() == docs.count() and spotsigs.edits(empty).count() == 0
    pairs = {(r.a, r.b) for r in spotsigs.near_pairs(spotsigs.fingerprints(docs.filter("doc_id IS NOT NULL"))).collect()}
    assert pairs == {(1, 3)}


PAGE = '<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><a href="/">Home</a></nav><article><h1>Head &amp; line</h1><p>Some   words\n here.</p><div class="share">Share</div><p>More &eacute; words</p></article><div class="comments"><p>nice</p></div><footer>end</footer></body></html>'


def test_html_main(spark):
    text = "Head & line\n\nSome words here.\n\nMore é words"
    assert html_main.main_text(PAGE, html_main.DEFAULT) == text
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words"), (5, "u", PAGE[:330])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert got[1] == text and got[2] == got[3] == "" and got[4] == "plain words" and got[5].startswith("Head & line")
    assert html_main.extract(pages.limit(0)).count() == 0


def test_html_names_and_implied_ends():
    text = lambda page: html_main.main_text(page, html_main.DEFAULT)
    body = "<p>Some words of the article here.</p>"
    for wrapper in ("class='content with-sidebar'", "class='page has-header'", "class='sidebar'", "title='the hidden valley'", "data-class='ad'", "title='class=ad'"):
        assert text(f"<div {wrapper}><article>{body}</article></div>") == "Some words of the article here."
    for part in ("<h2 id='related-work'>", "<section id='comments-on-method'>", "<div class='entry-header'>", "<h2 class='header'>"):
        tag = part[1:].split()[0]
        assert text(f"<article>{part}These words are kept</{tag}>{body}</article>") == "These words are kept\n\nSome words of the article here."
    for part in ("<div class='ad'>x</div>", "<div class='site-footer'>x</div>", "<p hidden>x</p>", "<div class='a share-buttons'>x</div>", "<div style='display: none'><p>x</div>"):
        assert text(f"<article>{part}{body}</article>") == "Some words of the article here."
    assert text(f"<article><p class='ad'>x{body}</article>") == "Some words of the article here."
    assert text("<article><ul><li>one<li class='share'>x<li>two</ul><p>three</article>") == "one\n\ntwo\n\nthree"
    assert text("<article><div><div><span class='ad'>x</div></div><p>three four</article>") == "three four"
    assert text("<article><table><tr><td class='ad'>x<td>one two three four five six<tr><td>seven eight nine ten</table><p>more words</article>") == "one two three four five six\n\nseven eight nine ten\n\nmore words"
    assert text("<article><span><div class='ad'>x</span>y</div><p>three four</article>") == "three four"


def test_host_rules(docs, empty):
    got = {r.doc_id: r for r in host_rules.apply_rules(docs).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (300, False, True)
    assert (got[11].n_words, got[11].n_repeat_words, got[11].base_failed) == (6, 5, True)
    assert (got[4].n_words, got[4].word_chars, got[6].n_words) == (0, 0, 0)
    assert host_rules.apply_rules(empty).count() == 0
    assert host_rules.keep_documents(docs).columns == docs.columns
