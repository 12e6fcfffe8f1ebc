"""URL filter, WARC archives and chat formatting against plain Python."""

import base64
import gzip
import hashlib
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starledger.llm import chat_format, url_filter, warc
from starledger.llm.queries import URL_RULES
from starledger.session import scratch_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("Host", T.StringType()),
                      T.StructField("kind", T.LongType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", 5) for i, u, h in rows], PAGES)


# ---------------------------------------------------------------- URL filter

def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].encode().lower().decode()
    tail = rest[cut:]
    return host, tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def judged(url, listed):
    host, path = parts(url)
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, action = max(fits)
        return host, path, rule, action
    return host, path, None, "block" if host in listed else "allow"


def urls():
    rng = random.Random(9)
    hosts = [f"h{i}.example.org" for i in range(150)] + ["WWW.Example.COM", "a.www.example.com", "example.com",
             "badexample.com", "x.net", "net", "É.org", "", "com"]
    odd = [None, "", "no scheme", "http://", "http://a://b/c", "x://y?z/en/", "http://net#/es/", "http://h1.example.org\n/p"]
    tails = ["", "/", "/en/x", "/es/?q=/", "/fr/a#b", "?a", "#b", "/EN/"]
    return odd + [f"http://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(600)]


@pytest.mark.parametrize("max_bytes", [url_filter.MAX_FILTER_BYTES, 1])
def test_verdicts_equal_brute_force(spark, max_bytes):
    rows = [(i, u, "") for i, u in enumerate(urls())] + [(None, "http://h1.example.org/", ""), (3, None, "")]
    listed = {f"h{i}.example.org" for i in range(0, 150, 3)} | {"É.org", "not.in.corpus", ""}
    names = spark.createDataFrame([(h,) for h in [*listed, None, "h0.example.org"]], "key string")
    got = url_filter.judge(pages(spark, rows), names, URL_RULES, max_bytes=max_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *judged(u, listed)) for i, u, _ in rows), key=str)


def test_cascade_is_exact_for_the_whole_universe(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"),
                                      (F.col("id") % 17 == 0).alias("listed")).cache()
    built = url_filter.cascade(keys)
    assert len(built.sizes) > 2
    assert keys.filter(built.listed(F.col("key")) != F.col("listed")).count() == 0


def test_no_list_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "key string")
    got = url_filter.judge(pages(spark, [(1, "http://a.b/c", "")]), none, ()).collect()
    assert [tuple(r) for r in got] == [(1, "a.b", "/c", None, "allow")]
    assert url_filter.judge(pages(spark, []), none, URL_RULES).count() == 0


# ---------------------------------------------------------------- WARC

def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def web():
    rng = random.Random(6)
    bodies = ["", None, "<p>é</p>", "a\r\n\r\nb", "WARC/1.1\r\n", "x" * 400_000]
    rows = [(i, f"http://h/{i}\r\nX-Evil: 1", rng.choice(bodies)) for i in range(60)]
    rows += [(i, None, f"<html>{rng.random()}</html>" * rng.randint(1, 50)) for i in range(60, 160)]
    rng.shuffle(rows)
    return rows


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        body = h or ""
        first[body] = min(first.get(body, i), i)
    out = []
    for i, _, h in rows:
        body = h or ""
        copy = i != first[body] and len(body.encode()) >= least
        out.append((i, len(body.encode()), digest(h), "revisit" if copy else "response", first[body] if copy else None))
    return sorted(out)


@pytest.mark.parametrize("least, roll", [(0, 1 << 28), (1, 2000)])
def test_archives_read_back(spark, least, roll):
    rows = web()
    got = warc.archived(pages(spark, rows), scratch_path(spark, "warc-test"), min_bytes=least, roll_bytes=roll, shards=3)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in got.collect()) == expected(rows, least)
    assert all("\n" not in r.url for r in got.collect())


def test_same_pages_give_the_same_bytes(spark):
    rows, sums = web(), []
    for turn in range(2):
        folder = scratch_path(spark, "warc-test")
        manifest = warc.write(pages(spark, rows[::-1] if turn else rows).repartition(2 + turn), folder, shards=4, roll_bytes=3000)
        listed = sorted(map(tuple, manifest.collect()))
        path = folder.removeprefix("file://").removeprefix("file:")
        assert not [f for f in os.listdir(os.path.join(path, "_temporary")) if f.endswith(".gz")] if os.path.isdir(
            os.path.join(path, "_temporary")) else True
        for name, _, n, size, sha in listed:
            data = open(os.path.join(path, name), "rb").read()
            assert len(data) == size and hashlib.sha256(data).hexdigest() == sha
            assert gzip.decompress(data).count(b"WARC-Record-ID") == n + 1
        assert len({s for _, s, *_ in listed}) == 4 and len(listed) > 4
        sums.append(listed)
    assert sums[0] == sums[1]


def test_repeated_pages_missing_ids_and_no_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (None, "v", "alone"), (2, "w", None)]
    got = warc.archived(pages(spark, rows), scratch_path(spark, "warc-test"), shards=2).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_digest) for r in got) == sorted([
        (1, "response", -1, digest("same")), (1, "revisit", 1, digest("same")), (-1, "revisit", 1, digest("same")),
        (-1, "response", -1, digest("alone")), (-1, "revisit", -1, digest("alone")), (2, "response", -1, digest(""))])
    assert warc.archived(pages(spark, []), scratch_path(spark, "warc-test")).count() == 0


def test_a_damaged_archive_is_refused(spark):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write(pages(spark, [(1, "u", "payload " * 50)]), folder, shards=1)
    path = os.path.join(folder.removeprefix("file://").removeprefix("file:"), manifest.first().file)
    data = gzip.decompress(open(path, "rb").read()).replace(b"payload payload", b"payload PAYLOAD", 1)
    with open(path, "wb") as out:
        out.write(gzip.compress(data))
    with pytest.raises(Exception, match="digest|records|WARC"):
        warc.read(spark, folder).collect()


# ---------------------------------------------------------------- chat

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("Position", T.StringType()), T.StructField("block", T.LongType())])


def rendered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "unknown", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        for p in {r for _, _, r, _ in turns if r != "system"}:
            at = 0
            for k, (_, _, r, x) in enumerate(turns):
                head = "<|" + ("assistant" if r == p else r if r == "system" else f"user name={r}") + "|>\n"
                segment = head + x + "<|end|>\n"
                mask = (at + len(head), at + len(segment)) if r == p else (None, None)
                out.append((c, p, k, r, segment, at, *mask))
                at += len(segment)
    return sorted(out, key=str)


def test_perspectives_equal_brute_force(spark):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "anna", "bo", None, "system"]), rng.choice(["", None, "héllo", "x\ny", "a"]))
            for c in [*range(12), None] for t in [None, *range(rng.randint(1, 9)), 2]]
    rows += [(77, t, "user" if t % 2 else "guest", f"turn {t % 7}") for t in range(600)]     # one long dialogue
    rows += [(78, 0, "system", "only context"), (79, 1, "user", "same"), (79, 1, "user", "same")]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, "p", 3) for r in rows], TURNS).repartition(6)
    got = sorted((tuple(r) for r in chat_format.perspectives(turns).collect()), key=str)
    assert got == rendered(rows)


def test_masks_cover_the_assistant_words_only(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello")]
    got = chat_format.perspectives(spark.createDataFrame([(*r, "p", 3) for r in rows], TURNS)).collect()
    for person, word in (("ann", "hi"), ("bob", "hello")):
        parts_ = sorted((r for r in got if r.perspective == person), key=lambda r: r.position)
        whole = "".join(r.segment for r in parts_)
        marked = [whole[r.mask_start:r.mask_end] for r in parts_ if r.mask_start is not None]
        assert marked == [word + "<|end|>\n"] and "<|assistant|>\n" + word in whole
    assert chat_format.perspectives(spark.createDataFrame([], TURNS)).count() == 0
