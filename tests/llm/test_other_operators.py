import datetime as dt
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from factorweave.llm import chat, html_main, url_filter


def test_chat_round_trip(spark):
    rng = random.Random(3)
    marks = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x", "plain", "é漢\U0001f600", "%0A", "\n", "<", "|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol", None]), None if rng.random() < 0.1 else " ".join(rng.choice(marks) * rng.randrange(3) + "word " * rng.randrange(40) for _ in range(3)), "x") for c in range(25) for t in range(rng.randrange(1, 9))]
    rows += [(30, 0, "assistant", "again", "x")] * 2 + [(None, None, "assistant", "no id", "x"), (31, 0, "assistant", "long " * 5000, "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window string")
    out = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(table, 200, 60)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(table.limit(0))).count() == 0


def test_chat_windows_keep_budget_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * 20) for t in range(1, 30)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 120, 60).orderBy("window").collect()
    assert len(windows) > 3 and all(w.tokens <= 120 for w in windows)
    assert all(chat.read_turns(w.formatted)[0] == ("system", "be kind") for w in windows)
    assert all(w.repeated > 1 for w in windows[1:])
    assert Counter(w.formatted[a:b] for w in windows for a, b in zip(w.loss_spans[::2], w.loss_spans[1::2], strict=True)) == Counter(x for _, _, r, x in rows if r == "assistant")


def test_chat_windows_repeat_a_long_system_turn(spark):
    long = "rule " * 600
    rows = [(1, 0, "system", long)] + [(1, t, "user" if t % 2 else "assistant", f"turn {t} " + "word " * 20) for t in range(1, 9)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("window").collect()
    turns = [chat.read_turns(w.formatted) for w in windows]
    assert len(windows) > 3 and all(t[0] == ("system", long) for t in turns)
    assert [x for w, t in zip(windows, turns, strict=True) for x in t[w.repeated :]] == [(r, x) for _, _, r, x in rows]


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\\\|", "a<|b<\\|c", "<<||", "\\<|", "|<"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a> <a>News</a></nav></header><div class="cookie-notice">We use cookies. Accept?</div>
<div id="content"><h1>Real title</h1><p>A long paragraph of the article with many words, &eacute;&#233; and <b>bold</b>  text
that goes on for a while and ends here.</p><div class="ad">Buy now! Cheap things for all of you.</div><p>Short one.</p>
<ul><li>First item of a list<li>second</ul><p>Another paragraph with enough text to be content, surely, by any measure.</p>
<section id="comments"><h3>Comments</h3><p>I liked this article very much, it is a long comment by a reader of the page.</p></section></div>
<aside><p>A long sidebar text that goes on and on and would look like an article paragraph if it were not in an aside.</p></aside>
<form><label>Email</label><button>Go</button></form><footer>&copy; 2024</footer><SCRIPT>var x="<p>no</p>"</script><style>p{}</style></body></html>"""


def test_html_main_text(spark):
    assert html_main.main_text(PAGE).split("\n\n") == [
        "Real title", "A long paragraph of the article with many words, éé and bold text that goes on for a while and ends here.", "Short one.", "First item of a list", "second", "Another paragraph with enough text to be content, surely, by any measure.",
    ]
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (3, "u", "<article>One &amp;amp; two<p>three <b>x", "x"), (4, "u", "<p>" * 5000 + "<" * 5000, "x")]
    out = html_main.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id == 3} == {"One &amp; two\n\nthree x"}
    assert {r.text for r in out if r.page_id in (2, None)} == {""}
    assert html_main.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_pages_cut_off_and_very_long():
    import time

    whole = "<p>A paragraph that is long enough to be kept as content, surely.</p>"
    kept = "A paragraph that is long enough to be kept as content, surely."
    for cut_off in ("<a " + "b" * 50_000, "<a href='x", '<a title="never closed', "<!-- never closed", "<", "</", "<!", "<script>x", "<svg>" * 3):
        assert html_main.main_text(whole + cut_off).split("\n\n")[0] == kept
    assert html_main.main_text(f"<b title='1>2' class=x>{whole}</b><i title=it's>{whole}").split("\n\n") == [kept, kept]
    pages = [
        "".join(f"<p>{kept if i % 2 else 'x'}</p>" for i in range(10_000)), "<div>x" * 10_000, "<div class=ad>x<article>" * 5_000, whole + '<a x="' * 20_001, "<svg>" * 20_000,
        "<b><td>" + "<div>" * 10_000 + "</b>" * 10_000, "<" * 100_000, "".join(f"<div class={'content' if i % 3 else 'ad'}>{whole}<a href=x>link</a></div>" for i in range(4_000)),
    ]
    for page in pages:
        began = time.time()
        html_main.main_text(page)
        assert time.time() - began < 5


def test_html_cut_decides():
    # blocks whose own cost says otherwise take the side of what stands around them, on the tables' pages as well
    page = f"<article><p>{'A long sentence of the article. ' * 8}</p><p>Yes.</p><p>{'Another long sentence of it. ' * 8}</p></article><div class=sidebar><p>{'A long sentence of the sidebar. ' * 8}</p></div>"
    labelled = html_main.labelled(page)
    assert [(html_main.classify(b) > 0, keep) for b, keep in labelled] == [(True, True), (False, True), (True, True), (True, False)]
    import pandas as pd

    flipped = sum((html_main.classify(b) > 0) != keep for page in pd.read_parquet("/root/testdata/sf0.001/pages.parquet", columns=["html"]).html.dropna() for b, keep in html_main.labelled(page))
    assert flipped > 0


def test_minimum_cut_equals_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randrange(2, 9)
        unary = [rng.randrange(-20, 21) for _ in range(n)]
        edges = [(i, i + 1, rng.randrange(1, 12)) for i in range(n - 1)] + [(i, i + 2, rng.randrange(1, 8)) for i in range(n - 2) if rng.random() < 0.4]
        cost = lambda keep: sum(abs(u) for u, k in zip(unary, keep, strict=True) if (u > 0) != k and u) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(html_main.minimum_cut(unary, edges)) == min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))


def day(text):
    return dt.date.fromisoformat(text)


def test_url_filter(spark, monkeypatch):
    entries = [
        ("bad.com", "block", "spam", day("2024-01-01"), "add"), ("bad.com", "block", "spam", day("2024-01-01"), "add"), ("bad.com", "block", "spam", day("2024-02-01"), "add"), ("bad.com", "block", "spam", day("2024-03-01"), "remove"),
        ("bad.com", "block", "spam", day("2024-05-01"), "add"), ("ok.bad.com", "allow", "good", day("2024-01-01"), "add"), ("site.org/a/b", "block", "path", day("2024-01-01"), "add"), (None, "block", "x", day("2024-01-01"), "add"), ("bad.com", None, None, None, "add"),
    ]
    cases = [
        ("http://bad.com/x", "2023-12-31", False), ("http://bad.com/x", "2024-01-01", True), ("http://www.BAD.com:80/x", "2024-02-29", True), ("http://bad.com", "2024-03-01", False), ("http://bad.com", "2025-01-01", True),
        ("http://ok.bad.com/", "2024-02-01", False), ("http://notbad.com/", "2024-02-01", False), ("https://site.org/a/b/c?q", "2024-02-01", True), ("https://site.org/a/bc", "2024-02-01", False), (None, "2024-02-01", False), ("no url", "2024-02-01", False), ("http://bad.com", None, False),
    ]
    captures = spark.createDataFrame([(i, u, day(d) if d else None, "x") for i, (u, d, _) in enumerate(cases)] * 2, "page_id bigint, url string, fetched_at date, rule string")
    table = spark.createDataFrame(entries, "pattern string, kind string, category string, at date, action string")
    out = url_filter.filter_urls(captures, table).collect()
    assert len(out) == 2 * len(cases) and all(r.blocked == cases[r.page_id][2] for r in out)
    monkeypatch.setattr(url_filter, "BROADCAST", 0)
    assert Counter(map(str, url_filter.filter_urls(captures, table).collect())) == Counter(map(str, out))
    assert url_filter.filter_urls(captures, table.limit(0)).where("blocked").count() == 0
    assert url_filter.filter_urls(captures.limit(0), table).count() == 0
