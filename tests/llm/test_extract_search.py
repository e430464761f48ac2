"""HTML extraction, WARC archives and nearest neighbours."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfolk.llm import hash_prefix_forest, html_suffix_array, warc
from kinfolk.llm.html_suffix_array import ARTICLE, OPEN, blocks_of, suffix_array


def text_of(html, kind=ARTICLE):
    return [t for k, t in blocks_of(html) if k == kind]


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div>
    <main><article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp;&lt;x&gt;<br>two<p>Open p
    <div class="ad">Buy</div><script>if (a<b) "</p>"</script><form><input>Mail me</form><ul><li>i1<li>i2</ul>
    <table><tr><td>a</td><td>b</td></tr></table><aside>Side</aside><section id="comments"><article class="comment">Nice!</article></section>
    </article></main><footer>&copy; foot</footer></body></html>"""
    assert text_of(page) == ["Head & line", "One bold <x> two", "Open p", "i1", "i2", "a b"]
    assert text_of("<article><p>cut &am") == ["cut &am"] and text_of("<article>a <b") == ["a"]
    assert text_of('<article title="a>b">x</article>') == ["x"] and blocks_of("") == [] and blocks_of("<<>>")
    assert text_of("<p>plain", OPEN) == ["plain"] and text_of("<main>m<div class='share'>s</div></main>") == ["m"]
    assert text_of("<div class=sidebar><p>never closed<article>kept</article>") == ["kept"]


def test_suffix_array_matches_sorted_suffixes():
    rng = np.random.default_rng(5)
    assert [len(x) for x in suffix_array(np.empty(0, np.int64))] == [0, 0]
    for n, kinds in ((1, 3), (2, 3), (7, 3), (200, 3), (60, 1), (300, 40)):
        t = np.concatenate((rng.integers(0, kinds, n), rng.integers(0, kinds, n // 2)))
        order, common = suffix_array(t)
        keys = [tuple(t[i:]) for i in range(len(t))]
        assert [keys[i] for i in order] == sorted(keys)
        want = [next((k for k, (x, y) in enumerate(zip(keys[i], keys[j])) if x != y), min(len(keys[i]), len(keys[j]))) for i, j in zip(order[:-1], order[1:])]
        assert common.tolist() == [0, *want]


def brute_extract(rows):
    """The rules of the operator by counting every run of every page in dictionaries."""
    hosts, out = {}, []
    for i, url, html in rows:
        hosts.setdefault(url.split("/")[2], {})[html] = html_suffix_array.stream_of(blocks_of(html))
    for i, url, html in rows:
        streams = {tuple(s) for s in hosts[url.split("/")[2]].values()}
        n, run = len(streams), html_suffix_array.MIN_RUN
        pages, holders = {}, {}
        for s in streams:
            for x in {s[k : k + run] for k in range(len(s) - run + 1)}:
                pages[x] = pages.get(x, 0) + 1
            own = {s[k + 1] for k in range(len(s) - 1) if s[k] == ARTICLE}
            for x in own:
                holders.setdefault(x, []).append(min(np.array(sorted(own - {x}), np.uint64).view(np.int64), default=0))
        mine = tuple(html_suffix_array.stream_of(blocks_of(html)))
        gone = set()
        for k in range(len(mine) - run + 1):
            if pages[mine[k : k + run]] >= max(3, 0.02 * n):
                gone |= set(range(k, k + run))
        at, text = 0, []
        for kind, t in blocks_of(html):
            if kind == ARTICLE:
                who = holders[mine[at + 1]]
                keep = not (len(who) >= max(5, 0.5 * n) and len(set(who)) >= 0.8 * len(who))
                at += 2
            else:
                words = range(at + 1, at + 1 + len(t.split(" ")))
                keep = kind == OPEN and sum(w in gone for w in words) < 0.9 * len(words)
                t = " ".join(w for k, w in zip(words, t.split(" ")) if k not in gone)
                at = words.stop
            if keep:
                text.append(t)
        out.append((i, "\n".join(text)))
    return out


def test_extraction_matches_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randint(1, 14)) for _ in range(12)]
    rows = []
    for k in range(150):
        part = lambda: rng.choice([f"<div>{rng.choice(shared)}</div>", f"<p>{say(rng.randint(1, 30))}</p>", f"<nav>{rng.choice(shared)}</nav>", f"<div class=ad>{say(5)}</div>"])
        inner = "".join(part() for _ in range(rng.randint(0, 6)))
        html = f"<body>{part()}<article><p>{say(20)}</p>{inner}</article>{part()}</body>" if k % 3 else f"<body>{inner}{part()}</body>"
        rows.append((k, f"http://h{k % 2 if k < 140 else k}.example/{k}", html))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 150, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (8, 1000):
        assert sorted((r.page_id, r.text) for r in html_suffix_array.extract(df, shard_pages=shard).collect()) == sorted(brute_extract(rows))


def test_repeats_decide_outside_the_article_and_names_inside_do_not(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    promo = "Get the big spring offer of our partners today and save"
    body = [say(40) for _ in range(40)]
    data = [(k, f"http://promo.example/{k}", f"<main><article><p>{body[k]}</p></article><div class=x>{promo}</div></main>") for k in range(20)]
    data += [(100 + k, f"http://inside.example/{k}", f"<article><p>{body[20 + k]}</p><p>Area {k} is <math><mi>r</mi></math> here</p><div class=x>{promo}</div></article>") for k in range(12)]
    near = [say(60) for _ in range(4)]
    data += [(200 + k, f"http://copies.example/{k}", "<article>" + "".join(f"<p>{p}</p>" for p in near) + f"<p>{say(3)}</p></article>") for k in range(15)]
    out = {r.page_id: r.text for r in html_suffix_array.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(out[k] == body[k] for k in range(20))
    assert all(out[100 + k].split("\n")[0] == body[20 + k] and out[100 + k].split("\n")[1:] == [f"Area {k} is r here"] for k in range(12))
    assert all(out[200 + k].split("\n")[:4] == near for k in range(15))


def test_covered_runs_are_cut_out_of_blocks(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"v{rng.randrange(9000)}" for _ in range(n))
    menu = "Home News Sport Travel Money Weather Shop Contact us now"
    own = [(say(12), say(9), say(30)) for _ in range(20)]
    lead = "All of our reports open with this very same sentence"
    data = [(k, f"http://cut.example/{k}", f"<body><div>{a} {menu} {b}</div><p>{c}</p>") for k, (a, b, c) in enumerate(own)]
    data += [(100 + k, f"http://lead.example/{k}", f"<nav>{menu}</nav><article><p>{lead} {c}</p></article>") for k, (_, _, c) in enumerate(own)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_suffix_array.extract(pages).collect()}
    assert all(out[k] == f"{a} {b}\n{c}" for k, (a, b, c) in enumerate(own))
    assert all(out[100 + k] == f"{lead} {c}" for k, (_, _, c) in enumerate(own))  # an article's text is its own
    marks = html_suffix_array.mark(html_suffix_array.parse(pages)).filter("host = 'lead.example'").collect()
    assert len(marks) == 20 and all(r.by_repeats == 1 and r.by_structure == 0 and list(r["drop"]) == [0] for r in marks)  # structure is not asked


@pytest.mark.parametrize("shard", [1, 2048])
def test_host_boilerplate(spark, shard):
    rng = random.Random(1)
    body = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(999)) for _ in range(30)) for _ in range(40)]
    frame = "<div>All about us and what we do</div>", "<div>Write to the editors of this site</div>"
    rows = [(k, f"http://Host.example/{k}", f"<body>{frame[0]}<p>{body[k]}</p>{frame[1]}") for k in range(20)]
    rows += [(100 + k, f"http://other{k}.example/", f"<body>{frame[0]}<p>{body[20 + k]}</p>") for k in range(3)]
    rows += [(200, "http://host.example/mirror", rows[3][2]), (201, "http://host.example/mirror", rows[3][2]), (300, None, rows[0][2]), (301, "no url", "<p>x"), (302, "http://e.example", None), (303, "http://e.example", ""), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], "page_id long, url string, html string, text string, rid int, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_suffix_array.extract(df, shard_pages=shard).collect()]
    assert len(got) == len(rows)
    by = {i: t for i, t, _ in got}
    assert all(by[k] == body[k] for k in range(20)) and by[200] == by[201] == body[3]
    assert all(by[100 + k] == f"All about us and what we do\n{body[20 + k]}" for k in range(3))
    assert by[300].split("\n") == ["All about us and what we do", body[0], "Write to the editors of this site"] and by[301] == "x" and by[302] == by[303] == ""
    assert all(n == len(t) for _, t, n in got)
    assert html_suffix_array.extract(df.limit(0)).count() == 0


def pages(spark):
    rng = random.Random(2)
    big = ["".join(rng.choice("abcdefghij \n<>é漢") for _ in range(n)) for n in (999, 1000, 5000, 200_000)]
    html = [None, "", "short", "short", *big, *big[1:], big[2], "x" * 1500, "<html>" + big[2]]
    rows = [(k, f"http://h/{k}" if k else None, h) for k, h in enumerate(html)] + [(None, "http://n\r\nWARC-Type: evil", big[1]), (5, "http://h/5", html[5])]
    return rows, spark.createDataFrame([(*r, "d", 7) for r in rows], "page_id long, url string, html string, digest string, refers_to int")


def test_warc(spark):
    rows, df = pages(spark)
    for size in (16 << 20, 700):
        out = warc.round_trip(df.repartition(3), range_bytes=size).collect()
        assert len(out) == len(rows)
        top = {}
        for i, _, h in rows:
            if i is not None:
                top[h or ""] = max(top.get(h or "", i), i)
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            again = len(b) >= 1000 and i != top[h]
            want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[h] if again else None))
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)
        full = {i: h or "" for i, _, h in rows}
        assert all(r.payload == full[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_ranges_own_each_record_once():
    data = b"".join(warc.member(k, f"http://h/{k}", ("\x1f" + "page %d " % k) * (k % 7 * 40), None) for k in range(60))
    data += warc.member(99, None, "z" * 300_000, None)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 61
    whole = [warc.parsed(r)[0] for r in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    for step in (1, 37, 250, 5000):
        got = [warc.parsed(r)[0] for a in range(0, len(data), step) for r in warc.records(io.BytesIO(data), len(data), a, min(len(data), a + step))]
        assert got == whole == [*range(60), 99]


def test_false_magic_is_no_record():
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    inner = warc.MAGIC + b"not a record" + gzip.compress(b"neither")
    data = stored.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n" + inner) + stored.flush() + warc.member(7, None, "p", None)
    starts = [a for a in range(len(data)) for _ in warc.records(io.BytesIO(data), len(data), a, a + 1)]
    assert len(starts) == 2 and starts[0] == 0


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, a in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q and len(a) == len(b))
            out[q] = d[:k]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows[50:80] = [(k, rows[100][1]) for k in range(50, 80)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [None] + [1.0] * 15), (5400, [float("inf")] * 16), (5500, [1.0] * 8), (5501, [2.0] * 8), (None, [1.0] * 16), (5600, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<double>, part int")
    got = {}
    for r in hash_prefix_forest.nearest(df, df.filter("id % 100 = 0"), shard=1500, block=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows, 10)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, min(10, len(want[q])) + 1))
        assert [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found) and q not in [i for _, _, i in found]
        hit += len({i for _, _, i in found} & {i for _, i in want[q]}) / len(want[q])
    assert hit / len(want) >= 0.9
    assert [i for _, _, i in sorted(got[100])] == list(range(50, 60))
    assert hash_prefix_forest.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [500, 2000, 8192])
def test_recall_of_the_forest_on_unclustered_vectors(rows):
    """The hardest case: directions without any structure, one path at every size."""
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:: rows // 50]
    planes = hash_prefix_forest.projections(64)
    strings = hash_prefix_forest.hash_strings(x.astype(np.float32), planes).T
    by = np.argsort(strings, axis=1, kind="stable")
    hit = hash_prefix_forest.candidates(np.take_along_axis(strings, by, axis=1), by, hash_prefix_forest.hash_strings(q.astype(np.float32), planes), 11, hash_prefix_forest.SHARE)
    near = np.argsort(-(q @ x.T), axis=1)[:, 1:11]
    assert np.take_along_axis(hit, near, axis=1).mean() >= 0.9 and hit.mean() < 0.4


def test_votes_are_common_prefix_lengths():
    rng = np.random.default_rng(5)
    strings = rng.integers(0, 1 << 32, (hash_prefix_forest.TREES, 300), np.uint64).astype(np.uint32)
    queries = strings[:, :4].T.copy()
    by = np.argsort(strings, axis=1, kind="stable")
    got = hash_prefix_forest.votes(np.take_along_axis(strings, by, axis=1), by, queries)
    common = np.zeros((4, 64, 300), int)
    for i in range(4):
        for t in range(64):
            common[i, t] = [32 - int(a ^ queries[i, t]).bit_length() for a in strings[t].tolist()]
    for i in range(4):
        level = next(b for b in range(32, 0, -1) if (common[i] >= b).sum() >= hash_prefix_forest.ENTRIES * 300)
        assert got[i].tolist() == np.maximum(common[i] - level + 1, 0).sum(0).tolist()


def test_host_of(spark):
    urls = ["http://User@Ex.com:80/a", "https://b.org?x", "ftp://c", "nothing", None, "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html_suffix_array.host_of(F.col("u"))).collect()] == ["ex.com", "b.org", "c", None, None, None]


def test_a_failed_archive_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://h/', id) as url", "case when id = 39 then cast(raise_error('broken') as string) else repeat('x', 2000) end as html")
    with pytest.raises(Exception, match="broken"):
        warc.write_archive(pages.repartition(4), path)
    assert not list((tmp_path / "archive").glob("*")) if (tmp_path / "archive").exists() else True
    warc.write_archive(pages.filter("page_id < 39").repartition(4), path)
    assert warc.read_archive(spark, path, range_bytes=500).count() == 39
