"""URL filters and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from paneloom.llm import url_filters, warc
from paneloom.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://WWW.Example.COM/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/9", "m.example.com", "/en/9", "example.com/en/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "com/", "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/x#y", "a.net", "/es/x", "net/es/", "block"),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?q=/en/", "a.com", "", None, None),
        ("a.com/en/", "", "", None, None),
        (None, "", "", None, None),
        ("x://", "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = url_filters.ruled(url_filters.with_parts(pages(spark, [url])), URL_RULES).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_trees_judge_the_rest(spark):
    urls = [f"http://h{i}.example.{'com' if i % 2 else 'net'}/{'es' if i % 2 == 0 else 'de'}/{i}" for i in range(60)] + ["http://q.org/es/7", None, "", "no scheme"]
    got = url_filters.judged(pages(spark, urls).withColumn("rule", F.lit("clash")).withColumn("depth", F.lit(1)), URL_RULES, trees=3).collect()
    assert len(got) == len(urls) and all(r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1 for r in got)
    assert all(r["depth"] == 1 for r in got)
    assert url_filters.judged(pages(spark, ["http://q.org/"]), []).first()["verdict"] == "allow"
    assert url_filters.judged(pages(spark, []), URL_RULES).count() == 0


def parsed(lines):
    """A tree of toDebugString as nested (feature, threshold, left, right) or a prediction."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = parsed(lines)
    assert lines.pop(0).strip().startswith("Else")
    return int(feature), float(threshold), left, parsed(lines)


def value(tree, x):
    return tree if isinstance(tree, float) else value(tree[2] if x[tree[0]] <= tree[1] else tree[3], x)


def test_scores_follow_from_the_trees(spark):
    """The score of every row against the sum of its leaves, walked by hand."""
    urls = [f"http://h{i % 23}.{'abc'[i % 3]}.{'com' if i % 5 else 'net'}/{'es' if i % 4 == 0 else 'de'}/{i * 7919}{'?a=1&b=2' if i % 2 else ''}" for i in range(200)] + ["http://q.org/es/7", "http://w.org", None]
    rows, labelled = url_filters.prepared(pages(spark, urls), URL_RULES, ["page_id", "url"])
    trees = url_filters.fit(labelled, trees=6, depth=3, least=2, step=0.3)
    text = trees.model.toDebugString.splitlines()[1:]
    weighted = []
    for line in text:
        if m := re.match(r"\s*Tree \d+ \(weight (\S+)\):", line):
            weighted.append((float(m[1]), []))
        else:
            weighted[-1][1].append(line)
    by_hand = [(w, parsed(lines)) for w, lines in weighted]
    assert len(by_hand) == 6 and any(not isinstance(t, float) for _, t in by_hand)
    for r in trees.scored(url_filters.with_shares(rows, labelled)).collect():
        x = [r[f] for f in url_filters.FEATURES]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * sum(w * value(t, x) for w, t in by_hand))), abs=1e-9)


def test_folds_are_judged_beside_a_constant(spark):
    urls = [f"http://h{i % 23}.{'abc'[i % 3]}.{'com' if i % 5 else 'net'}/{'es' if i % 4 == 0 else 'de'}/{i}" for i in range(120)]
    found = url_filters.held_out(pages(spark, urls), URL_RULES, trees=2)
    rows = found.collect()
    judged = url_filters.judged_by_folds(found).first()
    assert judged["n"] == len(rows)
    for p in ("score", "constant"):
        assert judged[f"{p}_accuracy"] == pytest.approx(sum((r[p] >= 0.5) == (r["label"] == 1) for r in rows) / len(rows))
        assert judged[f"{p}_loss"] == pytest.approx(-sum(math.log(r[p] if r["label"] == 1 else 1 - r[p]) for r in rows) / len(rows))


def test_shares_leave_their_own_fold_out(spark):
    """Against sums by hand: a labelled row's shares come from hosts of other folds, an unlabelled one's from all."""
    urls = [f"http://h{i % 9}.{'a' if i % 2 else 'b'}.{'com' if i % 3 else 'net'}/{'es' if i % 4 == 0 else 'de'}/{i}" for i in range(80)] + ["http://x.org/"]
    rows, labelled = url_filters.prepared(pages(spark, urls), URL_RULES, ["page_id", "url"])
    every = [r.asDict() for r in labelled.collect()]
    for out in (True, False):
        for r in url_filters.with_shares(labelled if out else rows, labelled, out_of_fold=out).collect():
            for key in ("suffix", "domain"):
                there = [x for x in every if x[key] == r[key] and not (out and x["fold"] == r["fold"])]
                assert r[f"{key}_share"] == pytest.approx((sum(x["label"] for x in there) + 1) / (len(there) + 2))
    again = url_filters.held_out(pages(spark, urls), URL_RULES, trees=2).collect()
    assert sorted(r["url"] for r in again) == sorted(x["url"] for x in every)


def lexical_by_hand(url):
    import math
    from collections import Counter

    host, path = (re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups() if "://" in url else ("", ""))
    host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host)
    n = max(len(url), 1)
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    first = re.match(r"/([^/]*)", path)
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "host_labels": len(host.split(".")), "digit_share": sum(c in "0123456789" for c in url) / n,
        "entropy": -sum(c / n * math.log2(c / n) for c in Counter(url).values()), "n_params": len(query.split("&")) if query else 0, "n_hyphens": host.count("-"), "has_fragment": "#" in url,
        "is_https": url.startswith("https://"), "has_www": host.startswith("www."), "first_segment_length": len(first[1]) if first else 0, "suffix": host.split(".")[-1], "domain": ".".join(host.split(".")[-2:]),
    }


def test_lexical_features(spark):
    urls = ["", "no scheme", "HTTP://A-b.Example.com", "https://www.x.co/a//b?p=1&q=2#f", "http://é.ü/ñ?", "ftp://h?x#y?z", "a://b://c/d#", "http://h1.net/" + "z" * 5000, "://", "http:///p?a&b&c"]
    for r in url_filters.lexical(url_filters.with_parts(pages(spark, urls))).collect():
        for k, v in lexical_by_hand(r["url"]).items():
            assert r[k] == (v if isinstance(v, str) else pytest.approx(float(v))), (r["url"], k)


def test_entropy_and_counts(spark):
    r = url_filters.lexical(url_filters.with_parts(pages(spark, ["http://aa.bb.co/x/y?p=1&q=2"]))).first()
    text = "http://aa.bb.co/x/y?p=1&q=2"
    import math

    assert r["entropy"] == pytest.approx(-sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)))
    assert (r["n_params"], r["depth"], r["host_labels"], r["suffix"], r["domain"]) == (2.0, 2.0, 3.0, "co", "bb.co")


HTML = [(1, "u1", "same"), (5, "u5\r\nx", "same"), (3, None, "same"), (2, "u", ""), (4, "u", None), (6, "u", "with\r\n\r\nWARC/1.1\r\nbreaks é"), (7, "v", "lone"), (7, "v", "lone"), (None, "w", "lone")]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    got = warc.round_trip(spark.createDataFrame(HTML, PAGES).withColumn("record_type", F.lit("clash")), min_bytes=min_bytes).collect()
    assert len(got) == len(HTML)
    for r in got:
        html = {h or "" for p, _, h in HTML if p == r["page_id"]}.pop().encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
        assert r["payload"] == (html if r["record_type"] == "response" else None)
        assert (r["refers_to"] is None) == (r["record_type"] == "response")
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got)
    if min_bytes == 0:
        assert kinds == [(0, "revisit", 7), (1, "revisit", 5), (2, "revisit", 4), (3, "revisit", 5), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0), (7, "revisit", 7)]
    else:
        assert all(k == "response" for _, k, _ in kinds)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archives(path):
    return [p.read_bytes() for p in sorted(path.rglob("part-*")) if p.is_file()]


def test_archive_bytes(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(HTML[:3], PAGES).coalesce(1), f"file://{tmp_path}/w", date="2024-01-01T00:00:00Z")
    each = [list(warc.parsed(m)) for data in archives(tmp_path / "w") for m in warc.members(data)]
    assert [len(found) for found in each] == [1, 1, 1]  # a member for each record
    records = [r for found in each for r in found]
    assert b"".join(gzip.decompress(data) for data in archives(tmp_path / "w")).count(b"WARC-Record-ID") == 3
    assert all(f["WARC-Date"] == "2024-01-01T00:00:00Z" for f, _ in records)
    ids = {f["WARC-Record-ID"] for f, _ in records}
    assert len(ids) == 3 and all(f["WARC-Refers-To"] in ids for f, _ in records if f["WARC-Type"] == "revisit")
    assert all(len(b) == int(f["Content-Length"]) for f, b in records)


def test_files_are_cut_by_bytes(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefghij") for _ in range(1000 if i else 30_000))) for i in range(60)]
    pages_ = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages_, f"file://{tmp_path}/w", file_bytes=8_000)
    files = archives(tmp_path / "w")
    assert sum(len(f) > 8_000 for f in files) == 1 and len(files) > 5  # the record over the bound has its own file
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {(r["page_id"], r["url"], r["payload"].decode()) for r in got} == set(rows)


def test_several_records_in_a_member():
    one = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    found = list(warc.members(gzip.compress(one + one) + gzip.compress(b"") + gzip.compress(one)))
    assert [len(list(warc.parsed(m))) for m in found] == [2, 1]
    with pytest.raises(ValueError):
        list(warc.members(gzip.compress(one)[:-3]))


def test_a_null_id_is_no_dash(spark):
    """Ids and urls that look like the marks for nulls, or that hold separators, are records of their own."""
    rows = [("-", "u", "x"), (None, "u", "x"), ("v-", "u", "x"), ("a|b", "c", "x"), ("a", "b|c", "x"), ("-", None, "x"), ("-", "-", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r["page_id"] or "", r["url"] or "") for r in got) == sorted((p or "", u or "") for p, u, _ in rows)
    assert sum(r["record_type"] == "response" for r in got) == 1
