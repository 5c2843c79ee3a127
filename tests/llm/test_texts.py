"""Token counts, quality rules, quality scores, web pages, and urls."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from driftpanel.llm import cotraining, html_text, link_graph, quality_rules, tokens

ODD_TEXTS = [
    None,
    "",
    " ",
    "a",
    "a  b\n\n c\t\td\r\n",
    "x\u00a0 y\u2003z \u3000w",
    "!\x1c ?\x1d\n a",
    "it's  we'll\n'tis   don't",
    "end <|endoftext|> of<|endoftext|>text <|endoftext|>",
    "naïve façade 東京 タワー 🙂🙂 12345 6",
    "w" * 30000,
    "many words " * 4000,
    "\n \n  \n   tail   ",
]


def test_token_counts_equal_the_library(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.model_path())
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choices(" \n\t\u00a0\x1cab1.'!é", k=rng.randrange(60))) for _ in range(300)]
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(texts)]
    for batch in (tokens.BATCH_BYTES, 50):
        got = tokens.token_counts(documents(*texts, extra="n_bytes string", values=("x",)), batch_bytes=batch).collect()
        assert sorted(map(tuple, got)) == want
    assert tokens.token_counts(documents("x").limit(0)).count() == 0


def test_forgetting_pieces_changes_nothing():
    calls = []
    encode = lambda pieces: [calls.append(p) or len(p) for p in pieces]
    texts = [f"word{i} word{i % 3}" for i in range(20)]
    known: dict = {}
    assert [tokens.count_tokens([t], encode, known, remembered=2) for t in texts] == [[len(t)] for t in texts]


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    gone = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(gone)


def test_base_statistics_equal_their_definition(spark, documents):
    rng = random.Random(2)
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 1000]
    texts += [" ".join(rng.choices(["a", "b", "#", "x|", "\n", "é<"], k=rng.randrange(120))) for _ in range(40)] + ["one two\n" * 9, "a b c d e f g h " * 3]
    docs = documents(*texts, extra="n_words string, rule int", values=("x", 1))
    got = {r.doc_id: r for r in quality_rules.judged(docs, []).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeats = want = plain_statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (not r.base_failed)


def test_learned_list_finds_planted_rules(spark, documents):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(25, 80))]
        bad = rng.random() < 0.3
        if bad:
            words = [w + "##" for w in words] if i % 2 else [w.upper() for w in words]
        texts.append(" ".join(words))
        labels.append((i, int(not bad), 0))
    labels += [(9999, 0, 0), (None, 0, 0), (3, None, 0)]
    docs = documents(*texts, None)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(docs, table)
    assert 1 <= len(rules) <= 4 and all(r.precision >= 0.9 for r in rules)
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs, rules).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in labels[:400]) >= 398 and got[400] is False
    assert quality_rules.learn_rules(docs, table.limit(0)) == []
    assert quality_rules.learn_rules(docs, table.where("quality = 1")) == []
    assert quality_rules.judged(docs.limit(0), rules).count() == 0


def test_rule_lists_are_ordered_conditions(spark):
    rules = [quality_rules.Rule((("n_words", "<=", 5.0), ("symbol_share", ">", 0.1)), 1.0, 9), quality_rules.Rule((("n_words", "<=", 8.0),), 1.0, 9)]
    df = spark.createDataFrame([(5, 0.2), (5, 0.1), (8, 0.9), (9, 0.9)], "n_words long, symbol_share double")
    assert [r.v for r in df.select(quality_rules.verdict(rules).alias("v")).collect()] == [0, 1, 1, None]
    assert str(rules[0]) == "n_words <= 5 and symbol_share > 0.1"


def quality_rows(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(10, 60))]
        text = " ".join(words if good else [w.upper() + "!!" if rng.random() < 0.7 else w for w in words])
        rows.append((i, text, rng.choice(["en", None]), ("good" if good else "bad") if rng.random() < 0.9 else "mixed", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_co_training_scores_unseen_documents(spark, documents):
    rows, labels = quality_rows(4, 500)
    odd = [(900, None, None, None, None), (None, "alpha beta", None, None, 3), (901, "", "en", "x", -4)]
    docs = documents(*rows, *odd, extra="score string, kept int", values=("x", 1))
    table = spark.createDataFrame(labels[:150] + [(900, None, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    model = cotraining.fit(docs, table)
    assert model.exchanged > 0
    got = {r.doc_id: r for r in cotraining.scored(docs, model).collect()}
    unseen = labels[150:]
    assert sum(got[i].kept == bool(q) for i, q, _ in unseen) / len(unseen) > 0.95
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in cotraining.scored(docs, None).collect()} == {0.5}
    assert cotraining.fit(docs, table.limit(0)) is None
    assert cotraining.fit(docs, table.where("quality = 1")) is None


def test_views_help_each_other():
    """Few labels, many unlabelled rows: exchanged labels make the weaker view better."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 1200).astype(float)
    text = (y[:, None] * 2 - 1) * np.array([2.0, 0, 0]) + rng.normal(size=(1200, 3))
    meta = (y[:, None] * 2 - 1) * np.r_[1.2, np.zeros(11)] + rng.normal(size=(1200, 12))
    few = slice(0, 24)
    accuracy = lambda m: ((cotraining.raw_score(meta[600:], m.meta) > 0) == y[600:]).mean()
    alone = cotraining.co_train(text[few], meta[few], y[few], text[24:600], meta[24:600], rounds=0)
    together = cotraining.co_train(text[few], meta[few], y[few], text[24:600], meta[24:600], confident=0.9)
    assert together.exchanged > 50 and accuracy(together) > accuracy(alone)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- <p>ad</p> -->
<div class="cookie-notice">We use cookies, a long notice text that nobody reads but that is longer than any paragraph of this page.</div>
<div class="ad">Buy</div><article><header><h1>Head&shy;line</h1></header><p>First <b>bold</b>text &lt;b&gt; &eacute;.<br>Next
 line<p>a &gt; b</article><aside>Side</aside><section id="comments"><article class="comment"><p>Reader says</p></article></section>
<form><p>Name</p></form><footer>&copy; us</footer></body></html>"""


def test_article_without_furniture():
    assert html_text.main_text(PAGE) == "Head\u00adline First boldtext <b> é. Next line a > b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text only, " * 8, ("plain text only, " * 8).strip()),
        ("<nav>menu</nav><footer>foot</footer>", ""),
        ("<article><p>cut in a ta", "cut in a ta"),
        ("<article><p>text<p", "text"),
        ("<article><p>5 < 6 & 7</p></article>", "5 < 6 & 7"),
        ("<ARTICLE><P CLASS='x'>Upper</P></ARTICLE>", "Upper"),
        ('<div class="ad"><article><p>wrongly nested</p></article>', "wrongly nested"),
        ("<main><script>x</main>", ""),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_distribution_decides_without_an_article_element():
    link = '<div><a href="/x">short link</a></div>'
    body = "".join(f"<p>{'sentence of the text number ' * 4}{i}</p>" for i in range(4))
    got = html_text.main_text(f"<body>{link * 5}<div>tiny</div>{link * 5}{body}{link * 6}<div>end</div></body>")
    assert got == " ".join(f"{'sentence of the text number ' * 4}{i}" for i in range(4))


def test_story_beside_article_cards_stays():
    card = '<article><h3><a href="/x">Card</a></h3><p>Short</p></article>'
    story = [f"{'sentence of the story number ' * 4}{i}" for i in range(4)]
    page = f"<body>{card * 3}<nav>{'<p>menu</p>' * 4}</nav>{''.join(f'<div>{x}</div>' for x in story)}</body>"
    assert html_text.main_text(page) == " ".join(story)
    for name in ("article", "main"):
        assert html_text.main_text(f"<{name}><p><a href='/x'>only a link</a></p></{name}>") == "only a link"


def test_article_text_weighs_more_than_text_beside_it():
    gap = f"<nav>{'<p>menu</p>' * 4}</nav>"
    page = lambda name: f"<body><div>{'x' * 200}</div>{gap}<{name}>{'y' * 50}</{name}>{gap}<div>{'z' * 50}</div></body>"
    assert html_text.main_text(page("article")) == f"{'x' * 200} {'y' * 50}"
    assert html_text.main_text(page("div")) == "x" * 200


def test_surges_and_dives():
    assert html_text.between_surges([0, 0, 3, 0, 0, 0, 90, 0, 5, 80, 0, 0, 0, 2]) == [False] * 6 + [True] * 4 + [False] * 4
    assert html_text.between_surges([]) == []
    assert html_text.between_surges([4]) == [True]


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 1), (2, "v", "<p>" + "x y " * 50000, 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def plain_rule(host, path):
    best = None
    for h, p, v in link_graph.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://www.example.com/fr/x", "http://net/es/a", "http://x.net/es", "http://x.net/es/?q=/fr/",
    "http://x.net?es/", "http://x.net#/es/", "ftp://b.org/a://c.com/d", "http://com", "http://com/", "http://notexample.com/en/", "http://xnet/es/", "http://ÄB.com/é", "://h/p", "http:///p",
]


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    for r in link_graph.judged(pages).collect():
        u = URLS[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else None
        host = "" if rest is None else re.split(r"[/?#]", rest)[0]
        path = "" if rest is None else re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), u
    assert link_graph.judged(pages.limit(0)).count() == 0


def test_trust_and_distrust_flow_over_links(spark):
    link = lambda *hosts: "".join(f"<a HREF='https://{h}/x'>l</a>" for h in hosts) + '<a href="/local">l</a>'
    graph = {
        "good.com": ["friend.org"], "friend.org": ["farm.org"], "farm.org": ["Spam-shop.org", "spam-two.org"], "feeder.org": ["farm.org"],
        "spam-shop.org": ["friend.org"], "spam-two.org": [], "lonely.org": [],
    }
    pages = spark.createDataFrame([(i, f"https://{h}/p", link(*to)) for i, (h, to) in enumerate(graph.items())], "page_id long, url string, html string")
    got = {r.host: r for r in link_graph.judged(pages).collect()}
    names = list(graph)
    edges = [(a, b.lower()) for a, to in graph.items() for b in to]

    def walk(seeds, pairs):
        start = {h: 0.15 / len(seeds) if h in seeds else 0.0 for h in names}
        rank = dict(start)
        for _ in range(link_graph.STEPS):
            fresh = dict(start)
            for a, b in pairs:
                fresh[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
            rank = fresh
        return rank

    trust, distrust = walk({"good.com"}, edges), walk({"spam-shop.org", "spam-two.org"}, [(b, a) for a, b in edges])
    for h in names:
        assert got[h].trust == pytest.approx(trust[h], abs=1e-12) and got[h].distrust == pytest.approx(distrust[h], abs=1e-12)
    least = link_graph.THRESHOLD * 0.15 / 2
    want = {h: "block" if distrust[h] >= least and distrust[h] > trust[h] else "allow" for h in names}
    assert {h: r.verdict for h, r in got.items()} == want
    assert want["feeder.org"] == want["spam-two.org"] == "block" and want["friend.org"] == want["lonely.org"] == "allow"


@pytest.mark.parametrize("part", ["<a ", "<script ", '<a "', "<a<a", "<!x", "<b>x", "</x>y", "<b>x</x>", "<!-- ", "<a b='", "<div class='ad'>x"])
def test_bad_markup_takes_time_in_proportion(part):
    import time

    seconds = []
    for size in (1 << 18, 1 << 20):
        began = time.process_time()
        html_text.main_text(part * (size // len(part)))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 12 * seconds[0] + 0.5 and seconds[1] < 8
