"""Token shards, line dedup and WARC derivatives: round trips and brute force."""

import gzip
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from .test_operators import docs, empty, odd, texts  # noqa: F401

from shutterlake.llm import line_dedup, queries, token_output, warc


def stream(df):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    return Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts(df))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_shards_round_trip(which, request, spark, tmp_path):
    df = request.getfixturevalue(which)
    if which == "odd":
        df = df.filter("text IS NULL OR text NOT LIKE '%<|endoftext|>%'")  # its token is the end id
    out = f"file://{tmp_path}/shards"
    rows = token_output.write_shards(df, queries.tokenizer("byte_bpe_50k.json"), out, length=64, per_shard=50).collect()
    reader = token_output.Reader(out)
    got = list(reader.read())
    assert len(got) == len(rows) == len(reader)
    assert sorted(r["slot"] for r in rows) == sorted(r["sequence"] for r in rows) == list(range(len(rows)))
    import zlib

    for r in rows:
        assert r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 128
        assert zlib.crc32(got[r["slot"]].tobytes()) == r["ids_crc32"]
    if len(got) > 60:
        assert [x.tolist() for x in reader.read(57)] == [x.tolist() for x in got[57:]]
        assert [r["sequence"] for r in sorted(rows, key=lambda r: r["slot"])] != list(range(len(rows)))
    # In stream order, without padding, the sequences are the documents' tokens.
    tokens = np.concatenate([got[r["slot"]][: r["n_tokens"]] for r in sorted(rows, key=lambda r: r["sequence"])]) if rows else np.empty(0, int)
    found, now = Counter(), []
    for t in tokens.tolist():
        if t == 50256:
            found[tuple(now)] += 1
            now = []
        else:
            now.append(t)
    assert not now and found == stream(df)
    assert {d for r in rows for d in r["doc_ids"]} == {d for d, _ in texts(df)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_one_and_can_be_inverted(n):
    slots = token_output.permuted(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert token_output.permuted(slots, n, 5, inverse=True).tolist() == list(range(n))
    if n > 64:
        assert slots.tolist() != token_output.permuted(np.arange(n), n, 6).tolist()


def brute_lines(rows):
    """(doc_id, line_no) -> (keep, size) over lines with a word."""
    places = {}
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if brute.WORD.search(x):
                places.setdefault(x, []).append((d, i))
    lines = list(places)
    sets = [frozenset(x.lower()[i : i + 5] for i in range(max(1, len(x.lower()) - 4))) for x in lines]
    of = {}
    for i, s in enumerate(sets):
        for g in s:
            of.setdefault(g, []).append(i)
    pairs = []
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in of[g] if j < i)
        pairs += [(i, j) for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    root = brute.classes(len(lines), pairs)
    first = lambda p: (p[0] is not None, p[0] or 0, p[1])
    keep, size = {}, Counter()
    for r, x in zip(root, lines):
        keep[r] = min([*places[x], *([keep[r]] if r in keep else [])], key=first)
        size[r] += len(places[x])
    return {p: (keep[r], size[r]) for r, x in zip(root, lines) for p in places[x]}, len(pairs)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_line_dedup(which, request):
    df = request.getfixturevalue(which)
    rows = [(d, t) for d, t in texts(df) if t is None or len(t) < 100_000] if which != "docs" else texts(df)
    df = df.filter("text IS NULL OR length(text) < 100000")
    want, _ = brute_lines(rows)
    got = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["n_lines"], r["kept"]) for r in line_dedup.verdicts(df).collect()}
    assert set(got) == set(want)
    wrong = [p for p in want if got[p][:2] != want[p]]
    assert len(wrong) <= 0.01 * len(want)  # the banding's recall at the threshold is 0.985
    assert all(kept == (p == keep) for p, (keep, _, kept) in got.items())
    clean = line_dedup.cleaned(df)
    assert clean.columns == df.columns and clean.count() == df.count()
    if which == "docs":
        for d, t in texts(clean):
            old = dict(rows)[d].split("\n")
            assert t == "\n".join(x for i, x in enumerate(old) if (d, i) not in got or got[(d, i)][2])


def test_line_dedup_family_of_variants(spark):
    """Hundreds of near lines in one group, and a chain whose ends are far apart."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the angry bear number "
    lines = [base + str(1000 + i) for i in range(300)] + ["short", "shorter", "a b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string")
    want, _ = brute_lines(list(enumerate(lines)))
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in line_dedup.verdicts(df).collect()}
    assert got == {p: k for p, (k, _) in want.items()}


def test_line_dedup_chain_through_lines_of_different_pivots(spark):
    """p1 ~ a ~ b ~ p2 in shared bands: a and b are covered by different pivots, and only their own link joins all."""
    rng = random.Random(4)
    at = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=240))]
    for k in range(3):
        at.append(at[-1][: 60 * k + 30] + "".join(rng.choices("0123456789", k=14)) + at[-1][60 * k + 44 :])
    p1, a, b, p2 = at
    lines = [p1, p2, a, b]
    sets = [line_dedup_shingles(x) for x in lines]
    near = {(i, j) for i in range(4) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {(2, 0), (3, 1), (3, 2)}
    assert joined_of_one_band(spark, lines) == [0, 0, 0, 0]


def joined_of_one_band(spark, lines):
    """Components of lines that all share one band and have sketches that allow anything."""
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id bigint, line string")
    members = spark.createDataFrame([(9, i, [0] * line_dedup.WORDS + [200]) for i in range(len(lines))], "band bigint, id bigint, sketch array<bigint>")
    return brute.classes(len(lines), {(r["u"], r["v"]) for r in line_dedup.edges(members, texts).collect()})


def test_line_dedup_compares_all_components_of_a_band(spark):
    """1 ~ 3, 2 ~ 4 and 3 ~ 4 of one band: the pivot knows only the first link."""
    rng = random.Random(8)
    one = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=240))
    at = [one]
    for k in range(3):
        at.append(at[-1][: 60 * k + 30] + "".join(rng.choices("0123456789", k=14)) + at[-1][60 * k + 44 :])
    other = ["".join(rng.choices("xyz", k=90)) for _ in range(20)]
    got = joined_of_one_band(spark, [at[0], at[3], at[1], at[2], *other])
    assert got[:4] == [0, 0, 0, 0] and got[4:] == list(range(4, 24))


def test_line_dedup_makes_a_pair_once_and_compares_the_nearest_first(spark):
    """Lines of their own components that share two bands: each pair is made in one of them, at first the nearest alone."""
    rng = random.Random(6)
    now, lines = rng.choices("abcdefghijklmnopqrstuvwxyz", k=240), []
    for k in range(12):
        now[k * 14 : k * 14 + 3] = rng.choices("0123456789", k=3)
        lines.append("".join(now))
    texts = spark.createDataFrame(list(enumerate(lines)), "id bigint, line string").coalesce(1)
    members = texts.join(line_dedup._sketches(texts), "id").selectExpr("explode(array(7L, 9L)) AS band", "id", "sketch")
    rows = line_dedup._mixed(members, spark.createDataFrame([], "node bigint, root bigint"))
    pairs = line_dedup._apart(rows, line_dedup.DEVIATIONS)
    got = [tuple(sorted((r["u"], r["v"]))) for r in pairs.collect()]
    sets = [line_dedup_shingles(x) for x in lines]
    assert len(got) == len(set(got))
    assert set(got) >= {(i, j) for j in range(12) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    nearest = [(r["u"], r["v"]) for r in line_dedup._nearest(pairs).collect()]
    assert {x for p in got for x in p} == {x for p in nearest for x in p} and len(nearest) <= 2 * 12 < len(got)


@pytest.mark.parametrize("size, least", [(9, 0.9), (16, 0.93), (36, 0.95), (90, 0.97), (400, 0.97)])
def test_line_dedup_recall_of_links(size, least):
    """Pairs of lines of just SIMILARITY or more: how many share a band and have sketches that allow it."""
    rng, lines = random.Random(size), []
    shingles = size - line_dedup.SHINGLE + 1
    for _ in range(600):
        a = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(size)]
        b = a[: size - shingles // 9] + ["\U0001f600"] * (shingles // 9) if shingles >= 9 else [*a, "z"]
        x, y = line_dedup_shingles("".join(a)), line_dedup_shingles("".join(b))
        assert 0.8 <= len(x & y) / len(x | y) < 0.89
        lines += ["".join(a), "".join(b)]
    bands, sketch = line_dedup.signature(lines)
    share = (bands[::2] == bands[1::2]).any(axis=1).mean()
    assert share >= least
    far = np.bitwise_count((x := sketch[::2, :-1] ^ sketch[1::2, :-1]).view(np.uint64) | x.view(np.uint64) >> np.uint64(1) & np.uint64(0)).sum()
    assert far <= 0.3 * 256 * len(lines) / 2


def test_line_similarity_is_jaccard(monkeypatch):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcd 日😀", k=rng.randrange(60))) for _ in range(60)]
    x = [rng.choice(base) for _ in range(400)]
    y = [t[: rng.randrange(len(t) + 1)] + rng.choice(["", "z", t[-3:]]) for t in x]
    want = []
    for a, b in zip(x, y):
        a, b = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
        want.append(len(a & b) >= 0.8 * len(a | b))
    assert line_dedup.similar(x, y).tolist() == want and 40 < sum(want) < 360
    monkeypatch.setattr(line_dedup, "SHORT", 20)
    assert line_dedup.similar(x, y).tolist() == want


def test_line_signatures_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    lines = ["", "a", "abcd", "abcde", "😀" * 9 + "é日"] + ["".join(rng.choices("abcdefg \U0001f600", k=rng.randrange(400))) for _ in range(40)]
    bands, sketch = line_dedup.signature(lines)
    monkeypatch.setattr(line_dedup, "PART", 16)
    for i, x in enumerate(lines):
        again = line_dedup.signature([x])
        assert again[0].tolist() == [bands[i].tolist()] and again[1].tolist() == [sketch[i].tolist()]
    least, filled = line_dedup.minima(lines)
    for x, row, n in zip(lines, least, filled):
        own = sorted(set(line_dedup._hashes(np.frombuffer(x.encode("utf-32-le").ljust(20, b"\0"), "<u4")).tolist()))
        assert n == len({h >> 56 for h in own})
        for k in (0, 1, 77, 255):  # the bin nearest by exclusive or, and the least in it
            at = min({h >> 56 for h in own}, key=lambda b: b ^ k)
            assert row[k] == min(h for h in own if h >> 56 == at)


def test_line_dedup_recall_of_band_keys(spark):
    """Pairs of lines of just SIMILARITY or more, changed at their end or in many places, share a band."""
    rows, want = [], {}
    for size, scattered, least in [(9, False, 0.9), (16, False, 0.93), (36, False, 0.95), (90, False, 0.97), (400, False, 0.97), (400, True, 0.9)]:
        rng, want[(size, scattered)] = random.Random(size), least
        for i in range(300):
            shingles = size - line_dedup.SHINGLE + 1
            if scattered:
                a = rng.choices("etaoin shrdlu", k=size)
                b = list(a)
                for at in range(20, 20 + 50 * (shingles // 45), 50):
                    b[at] = "#"
            else:
                a = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(size)]
                b = a[: size - shingles // 9] + ["\U0001f600"] * (shingles // 9) if shingles >= 9 else [*a, "z"]
            x, y = line_dedup_shingles("".join(a)), line_dedup_shingles("".join(b))
            assert 0.8 <= len(x & y) / len(x | y) < 0.89
            rows += [(size, scattered, i, "".join(a)), (size, scattered, i, "".join(b))]
    keys = {}
    df = spark.createDataFrame(rows, "size int, scattered boolean, i int, line string").coalesce(2)
    for r in line_dedup.band_keys(df).collect():
        keys.setdefault((r["size"], r["scattered"], r["i"]), []).append(set(r["bands"]))
    for which, least in want.items():
        share = np.mean([bool(a & b) for k, (a, b) in keys.items() if k[:2] == which])
        assert share >= least, (which, share)


def test_line_dedup_runs_no_python(spark):
    """Names, bands, sketches and exact comparisons are DataFrame operations."""
    texts = spark.createDataFrame([(1, "one line of words"), (2, "one line of word"), (3, "😀abc"), (4, "😀abd"), (5, "ab")], "id bigint, line string")
    pairs = spark.sql("SELECT * FROM VALUES (1L, 2L), (3L, 4L), (1L, 5L) AS t(u, v)")
    docs = texts.selectExpr("id AS doc_id", "line AS text")
    for df in (line_dedup.signed_lines(docs, "doc_id", "text"), line_dedup._sketches(texts), line_dedup._exact(pairs, texts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan
    assert {(r["u"], r["v"]) for r in line_dedup._exact(pairs, texts).collect()} == {(1, 2)}


def test_line_dedup_long_lines_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 16)
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh 😀", k=120))
    lines = [base, base[:118], base[:60], "ab", "".join(rng.choices("xyz", k=90))]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id bigint, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(i)], "u bigint, v bigint")
    assert {(r["u"], r["v"]) for r in line_dedup._exact(pairs, texts).collect()} == {(1, 0)}


def test_line_dedup_cleans_the_row_it_means(spark):
    """Rows of equal or no doc_id that share a line: only the later one's goes."""
    rows = [(None, "shared line of several words here\nonly in the first row of all"), (None, "quite another beginning of a text\nshared line of several words here"), (5, "one line of five\nsecond of five"), (5, "third of five is long enough\none line of five")]
    for parts in (rows, rows[::-1]):
        got = Counter(r["text"] for r in line_dedup.cleaned(spark.createDataFrame(parts, "doc_id bigint, text string")).collect())
        assert got == Counter([rows[0][1], "quite another beginning of a text", rows[2][1], "third of five is long enough"])


def line_dedup_shingles(line):
    return {line[i : i + line_dedup.SHINGLE] for i in range(len(line) - line_dedup.SHINGLE + 1)}


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>if (a < b) "</p>"</script></head>
<body><!-- no <p>text</p> --><h1>Head</h1><p class="a>b">One<br>two <b>bold</b> &lt;x&gt; <a href='/up?x=1&amp;y=2'>link</a><img src=pic.png></p>
<SCRIPT>gone()</SCRIPT><div>last é</div> 3 < 4"""


def test_page_text():
    text, title, links = warc.read_page(PAGE)
    assert title == "A & B"
    assert links == [("href", "/up?x=1&y=2"), ("src", "pic.png")]
    assert text == "Head\nOne\ntwo bold <x> link\nlast é\n3 < 4"
    for broken in ("<", "<p", "<!--", "<script>x", "a<b c='", "<title>t", "", "</p></p>", "<a href=>"):
        warc.read_page(broken)


def plain_page(page):
    """Text and title of a page by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.title, self.silent, self.titled = [], "", [], False

        def handle_starttag(self, tag, attrs):
            if tag == "title" and not self.silent:
                self.silent.append(tag)
                self.titled = not self.title
            elif tag in warc.SILENT - {"head"} and not self.silent:
                self.silent.append(tag)
            elif tag in warc.BLOCKS:
                self.text.append("\n")

        def handle_startendtag(self, tag, attrs):
            if tag in warc.BLOCKS:
                self.text.append("\n")

        def handle_endtag(self, tag):
            if self.silent and self.silent[-1] == tag:
                self.silent.pop()
                self.titled = False
            elif tag in warc.BLOCKS:
                self.text.append("\n")

        def handle_data(self, data):
            if self.titled:
                self.title += data
            elif not self.silent:
                self.text.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.text), " ".join(reader.title.split())


def coded_response(body, *http):
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Concurrent-To", "<urn:1>"), ("WARC-Concurrent-To", "<urn:2>")]
    return headers, block


@pytest.mark.parametrize("coding", ["", "gzip", "deflate", "raw", "broken"])
@pytest.mark.parametrize("chunked", [False, True])
def test_codings_and_repeated_headers(coding, chunked):
    import zlib

    page = b"<title>t</title><p>caf\xc3\xa9 and more</p>"
    raw = zlib.compressobj(wbits=-15)
    body = {"": page, "gzip": gzip.compress(page), "deflate": zlib.compress(page), "raw": raw.compress(page) + raw.flush(), "broken": page}[coding]
    http = [("Content-Type", "text/html"), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2")]
    http += [("Content-Encoding", {"raw": "deflate", "broken": "gzip"}.get(coding, coding))] if coding else []
    if chunked:
        http.append(("Transfer-Encoding", "chunked"))
        body = b"".join(b"%x;e=1\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    headers, block = coded_response(body, *http)
    (meta_headers, meta), (_, text) = warc.derive(headers, block)
    about = json.loads(meta)
    assert text.decode() == "café and more" and about["html"]["title"] == "t"
    assert about["http"]["headers"] == [list(x) for x in http] and about["source"] == [list(x) for x in headers]
    assert about["payload"]["actual_digest"] == warc.digest(body) and warc.value(meta_headers, "WARC-Source-Block-Digest") == warc.digest(block)


def test_parse_in_parts_of_any_size():
    records = [warc.response(i, f"http://{i}/", "<p>WARC/ " + "x" * (i * 37)) for i in range(12)]
    plain = b"".join(warc.serialise(*r) for r in records)
    packed = b"".join(gzip.compress(warc.serialise(*r)) for r in records)
    cut = gzip.compress(warc.serialise(*records[3])[:-60]) + gzip.compress(warc.serialise(*records[4]))
    for size in (1, 3, 64, 1 << 20):
        parts = lambda data, size=size: iter([data[i : i + size] for i in range(0, len(data), size)])
        for data in (plain, packed):
            assert [b for _, b in warc.parse(parts(data))] == [b for _, b in records]
        assert [b for _, b in warc.parse(parts(cut))] == [records[4][1]]
        assert len(list(warc.parse(parts(packed[:-5])))) == 11 or size


def test_derivatives(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(30)
    odd_pages = spark.createDataFrame([(1, None, None), (2, "http://a/", ""), (None, "not a uri ]", PAGE), (4, "http://b/", "x" * 200_000), (4, "http://b/", "x" * 200_000)], "page_id bigint, url string, html string")
    both = pages.unionByName(odd_pages).withColumn("record", F.lit("clash"))
    records = warc.responses(both)
    sources = {}
    for r in records.collect():
        ((headers, block),) = warc.parse(bytes(r["record"]))
        sources[warc.value(headers, "WARC-Record-ID")] = (headers, block)
    got = warc.derivatives(records).collect()
    assert len(got) == 2 * both.count()
    for r in got:
        headers, block = sources[r["refers_to"]]
        payload = block.partition(b"\r\n\r\n")[2]
        assert r["source_block_digest"] == warc.digest(block) and r["source_payload_digest"] == warc.digest(payload)
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        assert r["target_uri"] == warc.value(headers, "WARC-Target-URI")
        if r["record_type"] == "metadata":
            about = json.loads(r["block"])
            assert about["source"] == [list(h) for h in headers] and about["payload"]["length"] == len(payload)
            assert about["html"]["title"] == plain_page(payload.decode())[1]
        else:
            assert r["block"].split() == plain_page(payload.decode())[0].split()
    out = f"file://{tmp_path}/warc"
    files = warc.write(warc.derivatives(records), out).collect()
    assert sum(f["records"] for f in files) == len(got)
    found = Counter()
    for f in files:
        data = (tmp_path / "warc" / f["file"]).read_bytes()
        found.update((warc.value(h, "WARC-Record-ID"), b) for h, b in warc.parse(data))
        assert gzip.decompress(data).startswith(b"WARC/1.1")
        assert all(warc.value(h, "WARC-Refers-To-Target-URI") is not None and warc.value(h, "WARC-Refers-To-Date") for h, _ in warc.parse(data))
    assert found == Counter((r["record_id"], r["block"].encode()) for r in got)
    read = warc.read(spark, f"{tmp_path}/warc/*.warc.gz")
    assert read.count() == len(got) and warc.derivatives(read).count() == 0
    assert warc.derivatives(warc.responses(both.limit(0))).count() == 0


def test_parse_leaves_out_what_is_cut_off():
    whole = warc.serialise(*warc.response(1, "http://a/", "<p>x"))
    assert len(list(warc.parse(whole + whole[:-20]))) == 1
    assert len(list(warc.parse(gzip.compress(whole) + gzip.compress(whole)))) == 2
    assert list(warc.parse(b"")) == []
