"""URL filters, WARC archives and chats, with the odd cases of each."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from taskmill.llm.quotations import format_chats
from taskmill.llm.url_templates import RULES, filter_urls
from taskmill.llm.warc import assemble, parsed_records, read_warc, with_referred, write_warc

URLS = [
    None, "", "no scheme/path", "http://", "HTTPS://A.Example.ORG/es/1?x#y", "http://example.org/es", "http://example.org/en/1",
    "http://example.org/en/12/3", "http://sub.example.org/en/2", "http://badexample.org/es/", "http://com/fr/1", "http://x.com/fr",
    "http://x.com/de/a", "x://y.net?q=/de/", "x://y.net#f", "a://b://c/d", "http://É.com/de/1", "http://u@h.com:80/fr/1", "http://org/",
    "http://x.org", "http://x.net/" + "/".join("abcdefghijkl"), "line\nbreak://h.com/de/\nq",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([i for i, c in enumerate(path) if c in "?#"] or [len(path)])]


def ruled(host, path):
    fits = []
    for action, rule in RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS + URLS)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, segments int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = split(r.url)
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert verdict is None or r.verdict == verdict
        assert r.verdict in ("allow", "block")


def test_templates_of_a_host_learn_from_labels(spark):
    rows = [(f"http://shop.net/item/{i}", True) for i in range(40)] + [(f"http://shop.net/help/{i % 3}", False) for i in range(40)]
    rows += [(f"http://shop.net/item/{i}", None) for i in range(100, 110)] + [("http://shop.net/help/9", None), ("http://new.net/a", None)]
    docs = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {r.url: r for r in filter_urls(docs, rules=(), bad=docs["bad"]).collect()}
    assert all(got[f"http://shop.net/item/{i}"].verdict == "block" for i in range(100, 110))
    assert got["http://shop.net/item/101"].template == "/item/*" and got["http://shop.net/help/9"].verdict == "allow"
    assert got["http://new.net/a"].verdict == "allow"


def test_no_urls(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


PAGES = [
    (5, "http://a.net/x", "é" * 60), (3, "http://b.net/", "é" * 60), (9, None, "é" * 60), (3, "http://b.net/", "é" * 60),
    (1, "http://c.net", "short"), (2, "http://c.net", "short"), (4, "http://d.net/\r\nX: y", None), (6, "http://e.net", ""),
    (None, "http://f.net", "é" * 60), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9),
    (8, "u", "x" * 300_000), (None, None, None), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100),
]


@pytest.mark.parametrize("file_bytes", [1 << 24, 2000])
def test_archives_give_back_what_was_written(spark, tmp_path, file_bytes):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, type int")
    write_warc(pages, str(tmp_path / "w"), file_bytes=file_bytes)
    captures = with_referred(assemble(read_warc(spark, str(tmp_path / "w"))), "page_id").collect()
    least = {}
    for i, _, html in PAGES:
        if i is not None:
            least[html] = min(i, least.get(html, i))
    want, got = [], []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = least.get(html)
        again = len(data) >= 100 and first is not None and (i is None or i > first)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    for r in captures:
        page = dict(r.metadata.fields)["page_id"]
        got.append((int(page) if page else None, r.payload_bytes, r.payload_digest, r.type, int(r.referred) if r.referred else None))
        assert r.n_requests >= 1 and r.n_metadata >= 1
        if r.type == "response":
            assert r.computed_digest == r.payload_digest == hashlib.sha256(r.payload).hexdigest()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_pages(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert assemble(read_warc(spark, str(tmp_path / "w"))).count() == 0


def test_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: 2\r\n\r\nhi\r\n\r\n"
    records = [record % (b"warcinfo", b"i", b""), record % (b"metadata", b"m", b"WARC-Concurrent-To: <gone>\r\n"),
               record % (b"response", b"r", b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = assemble(read_warc(spark, str(tmp_path))).collect()
    assert [(r.record_id, r.request, r.n_metadata) for r in got] == [("<r>", None, 0)] * 2
    with pytest.raises(ValueError):
        list(parsed_records(io.BytesIO(records[0][:-8])))
    with pytest.raises(ValueError):
        list(parsed_records(io.BytesIO(b"junk\r\n")))


def chats(spark, rows):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, thread int")
    return {r.conv_id: r for r in format_chats(docs).collect()}


def test_quotes_are_linked_and_left_out(spark):
    rows = [
        (1, 0, "user", "Hello  there\nsecond line\n\nnew para"), (1, 1, "assistant", "> hello there\n> second line\nMy answer"),
        (1, 2, "user", "Bob wrote:\n>> Hello there\n> my answer\nthanks"), (1, 3, None, "unrelated"),
        (1, 4, "user", ">Unrelated\n\n> not found\nyes"), (1, 3, None, "unrelated"), (1, 5, "user", "> second line\r\n> my own words\nok"),
        (2, 0, "user", None), (2, 1, "user", "> only a quote"), (None, 1, "x", "y"), (3, None, "x", "y"),
        (4, 0, "user", "5 > 3 and\n a > b"), (4, 1, "user", "> hello there\nother conversation"), (4, 2, "user", "> later\nfirst"), (4, 3, "user", "later"),
    ]
    got = chats(spark, rows)
    one = got[1]
    assert [(m.turn, m.reply_to, m.thread, m.content) for m in one.messages] == [
        (0, None, 0, "Hello  there\nsecond line\n\nnew para"), (1, 0, 0, "My answer"), (2, 1, 0, "thanks"), (5, 0, 0, "ok"),
        (3, None, 3, "unrelated"), (4, 3, 3, "yes"),
    ]
    assert (one.n_messages, one.n_quotes, one.n_linked) == (6, 6, 5)
    assert one.chat.startswith("<|user|>\nHello  there\nsecond line\n\nnew para\n<|end|>\n<|assistant|>\nMy answer\n<|end|>\n")
    assert [(m.content, m.reply_to) for m in got[2].messages] == [("", None), ("", None)]
    assert [m.reply_to for m in got[4].messages] == [None] * 4 and got[4].messages[0].content == "5 > 3 and\n a > b"
    assert set(got) == {1, 2, 4}


def test_long_conversations_are_cut_and_stay_in_order(spark):
    rows = [(7, i, "user", f"line {i}" if i % 3 else f"> line {i - 1}\nanswer {i}") for i in range(1, 2500)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = sorted(format_chats(docs).collect(), key=lambda r: r.segment)
    assert sum(r.n_messages for r in parts) == 2499 and len(parts) > 2
    seen = set()
    for r in parts:
        for m in r.messages:
            assert m.reply_to is None or m.reply_to in seen
            seen.add(m.turn)
    assert sum(r.n_linked for r in parts) == 833


def test_a_chain_of_replies_is_one_thread(spark):
    rows = [(1, i, "user", f"> message {i - 1}\nmessage {i}" if i else "message 0") for i in range(40)]
    assert {m.thread for m in chats(spark, rows)[1].messages} == {0}


def test_no_messages(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_segments_go_by_the_number_of_messages(spark):
    rows = [(1, 1000 + i, "user", f"m{i}") for i in range(100)] + [(2, 1_700_000_000 + 3600 * i, "user", f"m{i}") for i in range(10)]
    got = chats(spark, rows)
    assert {c: r.n_messages for c, r in got.items()} == {1: 100, 2: 10}
    assert format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 2


def test_a_passage_goes_to_the_message_with_most_of_it(spark):
    rows = [
        (1, 0, "user", "Thanks.\nhello"), (1, 1, "user", "Thanks.\nA rather long line that only this one has\nanother"),
        (1, 2, "user", "Thanks."), (1, 3, "user", "> Thanks.\n> A rather long line that only this one has\nsure"),
        (1, 4, "user", "> Thanks.\nwelcome"), (1, 5, "user", "> Thanks.\n> words that nobody wrote, many more than the others\nhm"),
        (1, 6, "user", "> A rather   long line that\n> only this one has\nreflowed"), (1, 7, "user", "x" * 200_000 + "\n> hello"),
    ]
    got = {m.turn: m.reply_to for m in chats(spark, rows)[1].messages}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 2, 5: None, 6: 1, 7: 0}


def test_urls_keep_the_columns_of_the_user(spark):
    rows = [(1, "https://a.example.com/x/*/y", "h", "p", "r", "s", "b"), (2, None, "h", "p", "r", "s", "b"), (3, "x://h/" + "a/" * 60_000, "h", "p", "r", "s", "b")]
    docs = spark.createDataFrame(rows, "page_id long, url string, __host string, __path string, __rule string, __segments string, __bad string")
    got = filter_urls(docs).collect()
    assert {(r["__host"], r["__path"], r["__rule"], r["__segments"], r["__bad"]) for r in got} == {("h", "p", "r", "s", "b")}
    assert {r.page_id: len(r.path) for r in got}[3] == 120_001


def test_branches_without_labels_stay_apart(spark):
    rows = [(i, f"https://site.net/{['login', 'blog'][i % 2]}/{'abc'[i % 3]}") for i in range(12)]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {f"/{a}/{b}" for a in ("login", "blog") for b in "abc"}
    bad = [(i, f"https://site.net/{['spam', 'good'][i % 2]}/{i % 3}/x", i % 2 == 0 if i < 60 else None) for i in range(80)]
    frame = spark.createDataFrame(bad, "page_id long, url string, label boolean")
    got = filter_urls(frame, bad=F.col("label")).collect()
    assert {(r.template.split("/")[1], r.verdict) for r in got} == {("spam", "block"), ("good", "allow")}


def test_captures_of_pages_without_id(spark, tmp_path):
    from taskmill.llm.queries import op6_warc

    html = "x" * 200
    rows = [(None, "http://a/", html), (3, "http://b/", html), (None, None, None), (7, "http://c/", html), (None, "http://a/", html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op6_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([
        (None, 200, "revisit", 3), (None, 200, "revisit", 3), (3, 200, "response", None), (7, 200, "revisit", 3), (None, 0, "response", None)
    ], key=str)
