"""Each operator next to brute force, and its defined results for odd input."""

import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from riskloom.llm import langid, licenses, minhash, packing, pages, pii, quality, queries, tiling, toxicity, viterbi
from riskloom.llm.common import shingle_set, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, kept boolean, node string, key string, n int, a int, label int, found string, source_2 string, __id int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None, None, None, None), (None, "one two three four", "en", "s", 4), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4),
    (4, "Hello there, dear reader of this", "en", "s", 5), (4, "Hello there, dear reader of this", "en", "s", 5), (5, LONG, "en", "t", 6),
    (6, "12345 !!! 678", None, None, 3), (7, "İstanbul naïve façade ▁ \U0001f600", "tr", "t", 9),
]


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([r if len(r) == 5 else (r[0], r[1], "en", "s", 0) for r in rows], SCHEMA)
    return df.selectExpr("*", "0.5D AS score", "true AS kept", "'x' AS node", "'x' AS key", "1 AS n", "1 AS a", "1 AS label", "'x' AS found", "'x' AS source_2") if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, folder, duck, name):
    assert differences(queries.QUERIES[name](spark, folder), duck, queries.SQL[name]) == []


# --- 1 surrogates

def _swap(spark, *texts, key="k"):
    rows = docs(spark, list(enumerate(texts)))
    return [r.text for r in pii.pseudonymize(rows, key).orderBy("doc_id").collect()]


def test_surrogates_keep_format_and_coreference(spark):
    a, b, c = _swap(
        spark, "Call +1 (642) 555-8592 or +16425558592, mail Ann.1@Mail.org, ann.1@mail.org!", "Mrs. Anna Schmidt; MR. SCHMIDT; г-жа Анна",
        "card 4785-3805-9239-1139 / 4785380592391139, not 2123465659789240; 10.20.30.40; v1.2.3.4.5")
    nums = re.findall(r"\+1 ?\(?\d[\d ()-]+\d", a)
    assert len(nums) == 2 and len({re.sub(r"\D", "", n) for n in nums}) == 1 and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", nums[0])
    mails = re.findall(r"\S+@[\w.]+\w", a)
    assert len(set(mails)) == 1 and mails[0].endswith(".example.com") and "ann" not in a.lower().split()
    first, last = re.fullmatch(r"Mrs\. (\w+) (\w+); MR\. \w+; г-жа \w+", b).groups() if b else (None, None)
    assert b.split("; ")[1].startswith("MR. ") and first.endswith("na") and b.split()[-1].startswith(tuple("АБВГДЕЖЗИКЛМНОПРСТУФХ"))
    assert last.lower() in b.lower().split("; ")[1]
    cards = re.findall(r"4[\d-]{15,18}", c)
    assert cards[0].replace("-", "") == cards[1] and cards[1] != "4785380592391139"
    digits = [int(x) for x in cards[1]][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert "2123465659789240" in c and "v1.2.3.4.5" in c and "10.20.30.40" not in c


def test_clashing_surrogates_are_drawn_again(spark):
    """Seven one-letter boxes of one host in a space of 26: some clash, all end up apart and none is a real one."""
    letters = "abcdefgqrstuvwxyz"
    (text,) = _swap(spark, " ".join(f"{x}@b.co" for x in letters) + " " + " ".join(f"{x}@b.co" for x in letters))
    made = text.split()
    assert len(set(made)) == len(letters) and made[: len(letters)] == made[len(letters):]
    entities = spark.createDataFrame([("ssn", f"{i:03}-11-2222") for i in range(40)], "kind string, value string")
    again = pii.redrawn(entities, "k")
    assert again.columns == ["kind", "value", "draw"]


def test_surrogates_depend_on_the_key(spark):
    assert _swap(spark, "a.b@c.org", key="x") != _swap(spark, "a.b@c.org", key="y") == _swap(spark, "a.b@c.org", key="y")


def test_blank_fields_are_no_secrets(spark):
    texts = ["Password: ________", "token: --------", 'pwd="........"', "secret=-------a", "secret=-------b"]
    made = _swap(spark, *texts)
    assert made[:3] == texts[:3] and made[3] != made[4] and not {made[3], made[4]} & set(texts)


def test_surrogates_never_run_out(spark):
    """More numbers of five digits after a plus than the 4,096 surrogates of their form."""
    from pyspark.sql import functions as F

    entities = spark.createDataFrame([("phone", f"1{i:04}") for i in range(6000)], "kind string, value string")
    drawn = entities.join(pii.redrawn(entities, "k"), ["kind", "value"], "left").select(
        "value", pii.surrogate("k", F.col("kind"), F.col("value"), F.coalesce("draw", F.lit(0))).alias("made")).collect()
    assert len({r.made for r in drawn}) == 6000 and not {r.made for r in drawn} & {r.value for r in drawn}
    match = F.lit("+1 00 00")
    made = spark.range(1).select(pii._rendered(match, pii._units(match), F.array(F.lit("1234567"))).alias("t")).first().t
    assert made == "+1 23 4567"


def test_later_names_are_longer(spark):
    from pyspark.sql import functions as F

    made = spark.range(40).select(pii.surrogate("k", F.lit("surname"), F.lit("smith"), F.col("id")).alias("s")).collect()
    assert [len(r.s) for r in made[:29]] == [2 * (3 + i) + 1 for i in range(29)] and len({r.s for r in made}) == 40


def test_surrogates_of_odd_input(spark, odd, empty):
    out = pii.pseudonymize(odd)
    assert sorted(out.columns) == sorted([*odd.columns, "n_entities"])
    assert Counter(r.text for r in out.collect()) == Counter(r[1] for r in ODD)
    assert {r.n_entities for r in out.collect()} == {0} and pii.pseudonymize(empty).count() == 0
    hot = docs(spark, [(i, "to x@y.org.") for i in range(50)])
    assert len({r.text for r in pii.pseudonymize(hot).collect()}) == 1


# --- 2 near duplicates

def _brute(rows, k, percent):
    sets = [(d, set(shingle_set(t.encode() if t else None, k).tolist())) for d, t in rows]
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, sets):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return Counter((d, len(s), least.get(g), d is not None and d == least.get(g)) for g, (d, s) in zip(group, sets))


def _copies(seed, groups=6, size=25, length=60):
    """Groups that drift: each copy changes a word or two of an earlier one, so ends of a chain are far apart."""
    rng = np.random.default_rng(seed)
    rows, ids = [], iter(rng.permutation(10_000).tolist())
    for _ in range(groups):
        made = [[f"w{x}" for x in rng.integers(0, 5000, length)]]
        for _ in range(size):
            w = list(made[rng.integers(0, len(made))])
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, length)] = f"n{rng.integers(0, 9999)}"
            made.append(w)
        rows += [(next(ids), " ".join(w)) for w in made]
    return rows


@pytest.mark.parametrize("k, percent, budget", [(3, 85, 4), (5, 80, 0)])
def test_near_duplicates_against_all_pairs(spark, k, percent, budget, monkeypatch):
    """Both ways through the rounds: all pairs across components at once, and by a growing share of pivots."""
    monkeypatch.setattr(minhash, "FIRST_PIVOTS", 2)
    monkeypatch.setattr(minhash, "PAIRS_PER_NODE", budget)
    rows = _copies(5)
    got = minhash.near_duplicates(docs(spark, rows), k, percent)
    assert Counter(map(tuple, got.collect())) == _brute(rows, k, percent)


def test_near_duplicates_of_odd_input(spark, odd, empty):
    got = minhash.near_duplicates(odd, 3, 85)
    assert Counter(map(tuple, got.collect())) == _brute([r[:2] for r in ODD], 3, 85)
    assert minhash.near_duplicates(empty).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    mult = minhash._multipliers(160)
    for share in (0.5, 0.85, 0.95):
        n = 2000
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = base.copy()
        keep = int(2 * share * n / (1 + share))
        other[keep:] = rng.integers(0, 2**63, n - keep, dtype=np.uint64)
        a, b = (minhash.packed(minhash.minima(np.unique(x), mult)) for x in (base, other))
        planes = (a ^ b).reshape(minhash.BITS, -1)
        differ = sum(int(x & (2**64 - 1)).bit_count() for x in (np.bitwise_or.reduce(planes, axis=0)).tolist())
        estimate = ((160 - differ) / 160 - 0.25) / 0.75
        assert abs(estimate - share) < 0.2


# --- 3 packing

def _check_packing(rows, got, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.byte_bpe_path())
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    sequences, pieces = {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(pieces) == set(ids) and sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0  # no padding at all


def test_packing_round_trip(spark, folder, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    got = queries.op3_harmonic_packing(spark, folder).collect()
    _check_packing(rows, got)
    assert len({r.sequence_id for r in got if r.length < 2048}) < len(got)


def test_packing_of_odd_input(spark, empty):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|>b  \n c's"), (4, LONG), (5, "x" * 5000), (6, "İ naïve \U0001f600")]
    out = packing.pack(docs(spark, rows, extra=True))
    _check_packing(rows, out.collect())
    assert all(len(r.ids) == r.length for r in out.collect())
    assert packing.pack(empty).count() == 0
    assert packing.pack(docs(spark, [(1, "same text")] * 9)).agg({"length": "sum"}).first()[0] == 9 * 3
    assert packing.pack(docs(spark, [(None, "hi")])).first().doc_id is None


@given(st.integers(1, 20_000))
@settings(max_examples=200, deadline=None)
def test_cut_lengths_are_class_lengths(n):
    parts = packing.cut_lengths(n)
    assert sum(parts) == n and all(2048 % p == 0 for p in parts) and sorted(parts, reverse=True) == parts


# --- 4 languages

@given(st.text("ab ", max_size=30), st.text("abc ", max_size=12))
@settings(max_examples=150, deadline=None)
def test_phrases_are_greedy_longest_matches(sample, text):
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        n += 1
    assert langid.SuffixAutomaton(sample).phrases(text) == n


def test_language_accuracy_on_held_out(spark, folder, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = queries.op4_language_id(spark, folder).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_of_odd_input(spark, odd, empty):
    samples = {"a": " hello reader ", "b": " bonjour "}  # sample texts by language
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd, samples).collect()]
    assert Counter(x for _, x in got)["und"] == 4 and (4, "a") in got and len(got) == len(ODD)
    out = langid.labelled(docs(spark, ODD), samples)
    assert out.columns == SCHEMA_NAMES + ["lang_pred", "score"] and out.filter("score BETWEEN 0 AND 1").count() == len(ODD)
    assert langid.fit(empty) == {} and {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    marks = langid.identify(docs(spark, [(1, "² ½ ①"), (2, "hello ²")]), samples).collect()
    assert [r.lang_pred for r in sorted(marks)] == ["und", "a"]
    tie = langid.identify(docs(spark, [(1, "zz")]), samples).first()
    assert tie.lang_pred == "a" and tie.score == pytest.approx(0.5)


@pytest.mark.parametrize("rare", ["de", "en", "es", "fr"])
def test_a_language_of_few_labelled_rows_keeps_its_texts(duck, rare):
    rows = duck.execute("SELECT lang, text FROM documents WHERE length(text) BETWEEN 200 AND 4000 ORDER BY doc_id").fetchall()
    pools = {}
    for lang, text in rows:
        pools.setdefault(lang, []).append(langid.letters(text))
    samples = {k: f" {' '.join(itertools.chain(*v[: len(v) // 2]))} " for k, v in sorted(pools.items())}
    samples[rare] = f" {' '.join(pools[rare][0][:60])} "
    counts = langid.packer([langid.SuffixAutomaton(samples[k]).cost for k in samples])
    names = list(samples)
    for lang, texts in pools.items():
        held = texts[len(texts) // 2 :]
        right = sum(names[langid.classify(sum(map(counts, t)), len(names))[0]] == lang for t in held)
        assert right >= 0.9 * len(held), (lang, right, len(held))


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(1, "  12 " + "lorem ipsum dolor sit " * 6000, "la", "s", 0), (2, "plain words of english", "en", "s", 0)]
    samples = langid.fit(docs(spark, rows))
    assert sorted(samples) == ["en", "la"] and 50_000 < len(samples["la"]) <= langid.LONGEST_SAMPLE + 2 and samples["la"].startswith(" lorem ipsum ")


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


# --- 5 pages

def test_main_text_of_the_given_pages(spark, folder, duck):
    import html

    for page_id, text in [(r.page_id, r.text) for r in queries.op5_main_text(spark, folder).collect()]:
        source = duck.execute("SELECT html FROM pages WHERE page_id = ?", [page_id]).fetchone()[0]
        body = source[source.index("<article>") : source.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1|article)>", body)]
        assert text == "\n\n".join(b for b in blocks if b)


def test_main_text_leaves_out_the_rest():
    long = "A long enough paragraph of plain words that says something. " * 4
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site <a href=x>home</a></header><nav><ul><li>Menu</ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><aside>{long}</aside><div id=main><h1>Caf&eacute; &amp; more</h1><p>{long}<p>Short.<p>{long}"
        f"<form>Name <input></form></div><div class='user-comments'><p>{long}</div><script>var p='<p>no</p>';</script><footer>&copy; me</footer></body></html>")
    text = pages.main_text(page)
    assert text == "\n\n".join(["Café & more", long.strip(), "Short.", long.strip()])


def _page(body):
    return f"<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav>{body}<footer>me</footer></body></html>"


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_main_text_of_a_list_after_a_paragraph(outer):
    long, items = "word " * 199 + "words", [f"item number {i:08}" for i in range(100)]
    page = _page(f"<{outer}><p>{long}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></{outer}>")
    assert pages.main_text(page) == "\n\n".join([long, *items])


@pytest.mark.parametrize("outer", ["article", "div"])
def test_main_text_of_sections_beside_a_very_long_one(outer):
    parts = [f"Part {i}. " + "plain words " * 25 for i in range(12)]
    parts[0] = "Start. " + "very long text " * 1333
    page = _page(f"<{outer}>" + "".join(f"<section><h2>H{i}</h2><p>{t}</p></section>" for i, t in enumerate(parts)) + f"</{outer}>")
    assert pages.main_text(page) == "\n\n".join(x for i, t in enumerate(parts) for x in (f"H{i}", t.strip()))


def test_main_text_keeps_a_paragraph_in_a_container_of_links():
    long = "A paragraph that says something. " * 20
    page = _page(f"<div><p>{long}</p>" + "".join(f"<p><a href=x><b><i>link {i}</i></b></a></p>" for i in range(300)) + "</div>")
    assert long.strip() in pages.main_text(page).split("\n\n")


@pytest.mark.parametrize("open_tag", [
    "<main class='with-sidebar'>", "<div id=content class='has-sidebar'>", "<article class='post comments-open'>", "<article class='post sponsored'>",
    "<div class='widget'><main>", "<div class='share'><article>", "<div class='related'>", "<section id='related-work'>", "<div class='left sidebar-right-none'>"])
def test_names_of_layout_hide_no_text(open_tag):
    long = "A long enough paragraph of plain words that says something. " * 4
    page = _page(f"{open_tag}<h1>Top</h1><p>{long}</p><section id='related-work'><h2 id='search-algorithms'>Search algorithms</h2><p>{long}</p></section>"
                 f"<div class='comment-list'><p>{long}</p></div><div class='share-buttons'>Share</div><p>{long}</p>")
    assert pages.main_text(page) == "\n\n".join(["Top", long.strip(), "Search algorithms", long.strip(), long.strip()])


def test_most_of_the_text_stays_whatever_its_name():
    long = "A long enough paragraph of plain words that says something. " * 4
    assert pages.main_text(_page(f"<div class='widget'><p>{long}</p><p>{long}</p></div><div class='comments'><p>{long}</p></div>")).count("enough") == 8


def test_pages_of_odd_input(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a  b\n c"), (3, "u", "<<<>>& <p"), (3, "u", "<<<>>& <p"), (4, "u", "<p>" + LONG), (5, "u", "<nav>x</nav>")]
    got = {(r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()}
    assert {(1, ""), (2, ""), (None, "a b c"), (4, LONG), (5, "")} <= got
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 6 quality

@given(st.lists(st.sampled_from("abc"), max_size=60))
@settings(max_examples=100, deadline=None)
def test_repeated_words(tokens):
    from riskloom.llm.common import word_hashes

    runs = [tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)]
    twice = {k for k, n in Counter(runs).items() if n > 1}
    want = {i + j for i, r in enumerate(runs) if r in twice for j in range(8)}
    assert quality.repeated_words(word_hashes([t.encode() for t in tokens])) == len(want)


def test_bad_hosts_fail_their_documents(spark, odd, empty):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "too short", "en", "bad", 0) for i in range(90)] + [(i + 100, good, "en", "bad", 0) for i in range(10)]
    rows += [(i + 200, good, "en", h, 0) for i, h in enumerate(["fine"] * 100 + ["new"])] + [(400, good, "en", None, 0)]
    got = {r.doc_id: r.kept for r in quality.judge(docs(spark, rows)).collect()}
    assert not any(got[i] for i in range(110) if i in got) and all(got[i] for i in range(200, 301)) and got[400]
    assert quality.judge(odd).count() == len(ODD) and quality.judge(empty).count() == 0
    by = {(r.doc_id, r.n_words) for r in quality.judge(odd).collect()}
    assert {(1, 0), (2, 0), (3, 0), (5, 60_000), (None, 4)} <= by


# --- 7 licences

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction. The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""


def test_licences(spark, odd, empty):
    rows = [(1, MIT), (2, "Prose here. Licensed under the Apache License, Version 2.0.\nMore prose."), (3, "All rights reserved."),
            (4, "This work is licensed under the GNU General Public License, version 3. Released under the MIT License."), (5, "no license to speak of"),
            (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY 4.0."), (8, "Available under CC\nBY 4.0."), (9, "Available under CC_BY 4.0.")]
    got = {r.doc_id: r for r in licenses.recognise(docs(spark, rows)).collect()}
    assert got[1].licenses == "MIT" and got[1].sentences == "copyright_line mit_grant mit_notice asis_caps mit_liability"
    assert (got[2].licenses, got[3].status, got[4].licenses, got[5].status) == ("Apache-2.0", "unknown", "GPL-3.0 MIT", "none")
    assert (got[6].licenses, got[7].licenses) == ("CC-BY-NC-4.0", "CC-BY-4.0")
    assert got[8].licenses == got[9].licenses == "CC-BY-4.0"  # as in the SQL, which has no gate
    assert licenses.recognise(odd).filter("status = 'none' AND n_sentences = 0 AND licenses = ''").count() == len(ODD)
    assert licenses.recognise(empty).count() == 0


# --- 8 tiling

def _tile_slowly(x, y, least):
    fx, fy, out = [True] * len(x), [True] * len(y), []
    least = min(least, len(x))
    while least:
        best, found = least, []
        for i in range(len(x)):
            for j in range(len(y)):
                k = 0
                while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k] and fx[i + k] and fy[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            break
        for i, j in found:
            if all(fx[i : i + best]) and all(fy[j : j + best]):
                fx[i : i + best] = fy[j : j + best] = [False] * best
                out.append((i, j, best))
    return out


@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_tiles_against_all_starts(x, y):
    got = tiling.tile(np.array(x, np.uint64), np.array(y, np.uint64), 3)
    assert got == _tile_slowly(x, y, 3)


def test_reordered_passages_are_caught(spark, odd, empty):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 4000, n))
    a, b, c = text(12), text(12), text(12)
    bench = spark.createDataFrame([(1, f"{a}. {b}. {c}."), (2, text(40)), (2, None), (3, "tiny item"), (4, "")], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    rows = [(1, f"{text(50)} {c.upper()}, {text(5)} {a} {text(30)} {b}"), (2, text(200)), (3, f"{text(9)} {a} {text(40)}"), (4, "a tiny item here"), (5, None), (6, "")]
    want = {(1, 1, 3), (4, 3, 1)}
    assert {(r.doc_id, r.item_id, r.n_tiles) for r in tiling.contaminated(docs(spark, rows), bench).collect()} == want
    assert {(r.doc_id, r.item_id, r.n_tiles) for r in tiling.contaminated(docs(spark, rows), bench, broadcast_chars=0).collect()} == want
    assert tiling.contaminated(odd, bench, broadcast_chars=0).count() == 0
    assert tiling.contaminated(odd, bench).count() == 0 and tiling.contaminated(empty, bench).count() == 0
    assert tiling.contaminated(odd, bench.limit(0)).count() == 0


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=60), st.integers(0, 30))
@settings(max_examples=100, deadline=None)
def test_tiles_are_left_out_only_where_too_few_tokens_can_be_covered(x, y, need):
    x, y = np.array(x, np.uint64), np.array(y, np.uint64)
    whole, some = tiling.tile(x, y, 3), tiling.tile(x, y, 3, need)
    assert some == whole or (some == [] and sum(t[2] for t in whole) < need)


def test_repetitive_texts_are_tiled_quickly():
    page, item = np.arange(20_000, dtype=np.uint64) % 7, np.arange(1_000, dtype=np.uint64) % 7
    pieces = np.concatenate([np.r_[item[:n], 100 + n] for n in range(6, 200)]).astype(np.uint64)
    begin = time.perf_counter()
    assert tiling.tile(item, page) == [(0, 0, 1000)]
    assert sum(t[2] for t in tiling.tile(item, pieces)) > 900
    assert time.perf_counter() - begin < 2


def test_join_of_seeds_finds_what_the_tasks_find(spark, folder):
    given, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    again = given.select("doc_id", "text").unionByName(given.filter("doc_id % 3 = 0").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"))
    bench = bench.select("item_id", "text").unionByName(spark.createDataFrame([(None, "the of and"), (None, "the"), (-1, "")], "item_id long, text string"))
    rows = lambda df: sorted(map(str, df.collect()))
    near = rows(tiling.contaminated(again, bench))
    assert near and near == rows(tiling.contaminated(again, bench, broadcast_chars=0))
    assert rows(tiling.contaminated(again, bench, coverage=0.2)) == rows(tiling.contaminated(again, bench, coverage=0.2, broadcast_chars=0))


def test_planted_passages(spark, folder, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    whole = {(d, i) for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall() for i, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_tiling(spark, folder).collect()}
    assert whole <= got


# --- 9 token counts

def _reference(vocab, byte_fallback=True):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    tok = Tokenizer(models.Unigram(vocab, 0, byte_fallback))
    tok.normalizer = normalizers.Sequence([normalizers.Replace(Regex("[ \t-\r]+"), " "), normalizers.Replace(Regex("^ | $"), "")])
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=viterbi.MARK, prepend_scheme="always", split=True)
    return tok


def test_counts_equal_the_library(spark, folder, duck, odd, empty):
    tok = _reference(viterbi.vocabulary())
    got = {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, folder).collect()}
    for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        assert got[d] == len(tok.encode(t).ids)
    for r, (d, t, *_) in zip(viterbi.count_tokens(odd).orderBy("n_words", "doc_id").collect(), sorted(ODD, key=lambda x: (len(words((x[1] or "").encode())), x[0] is not None, x[0] or 0))):
        assert (r.doc_id, r.n_tokens) == (d, len(tok.encode(t).ids) if t and t.strip() else 0)
    assert viterbi.count_tokens(empty).count() == 0


@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-6, -1), max_size=12), st.text("abc", min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_ties_go_as_in_the_library(pieces, word):
    vocab = [("<unk>", 0.0), *((p, float(s)) for p, s in pieces.items())]
    want = len(_reference(vocab, byte_fallback=False).encode(word).ids)
    assert viterbi.Counter(vocab, byte_fallback=False)(viterbi.MARK + word) == want


# --- 10 toxicity

def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    h, dim = toxicity.HIDDEN, toxicity.DIM
    f = lambda *s: rng.standard_normal(s) * 0.5
    m = toxicity.Model({}, f(1, dim), f(4, dim), f(dim, 6 * h), f(6 * h), f(2, h, 3 * h), f(2 * h, h), f(h), f(2 * h), f(1))
    px, mask = f(3, 5, 6 * h), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    w = f(3)
    _, kept = toxicity.forward(m, px, mask, keep=True)
    g, dpx = toxicity.gradients(m, px, mask, kept, w)
    value = lambda: float(toxicity.forward(m, px, mask) @ w)
    for x, dx in [(getattr(m, k), v) for k, v in g.items()] + [(px, dpx * mask[:, :, None])]:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            if x is px and not mask[at[:2]]:
                continue
            old = x[at]
            x[at] = old + 1e-5
            up = value()
            x[at] = old - 1e-5
            assert (up - value()) / 2e-5 == pytest.approx(dx[at], rel=1e-4, abs=1e-7)
            x[at] = old


def _logit_slowly(m, many):
    """One window, one gate at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, x = toxicity.HIDDEN, [m.inputs([w])[0] @ m.wx + m.bx for w in many]
    states = np.zeros((len(many), 2 * h))
    for d, order in enumerate((range(len(many)), range(len(many) - 1, -1, -1))):
        now, u = np.zeros(h), m.uh[d]
        for t in order:
            part = x[t][3 * h * d : 3 * h * (d + 1)]
            z, r = sig(part[:h] + now @ u[:, :h]), sig(part[h : 2 * h] + now @ u[:, h : 2 * h])
            now = (1 - z) * now + z * np.tanh(part[2 * h :] + (r * now) @ u[:, 2 * h :])
            states[t, d * h : (d + 1) * h] = now
    weight = np.exp([np.tanh(s @ m.wa) @ m.va for s in states])
    return (weight / weight.sum()) @ states @ m.wo + m.bo[0]


def test_scores_are_those_of_the_best_window(spark):
    rng = np.random.default_rng(1)
    model = toxicity.train([(f"the garden is green today vile fool {i}".split(), 1) for i in range(40)] + [(f"the garden is green today {i}".split(), 0) for i in range(40)])
    vocab = ["garden", "green", "vile", "fool", "stranger", "the"]
    texts = [list(rng.choice(vocab, n)) for n in (1, 2, 31, 32, 33, 48, 49, 100, 145)]
    for text, got in zip(texts, toxicity.scorer(model)(texts)):
        begin = {*range(0, max(len(text) - toxicity.WINDOW, 0) + 1, toxicity.STRIDE), max(len(text) - toxicity.WINDOW, 0)}
        assert got == pytest.approx(max(_logit_slowly(model, text[b : b + toxicity.WINDOW]) for b in begin), rel=1e-3, abs=1e-3)
    phrase = toxicity.WINDOW - toxicity.STRIDE + 1
    for n in range(40, 90):  # every phrase lies whole in a window
        assert all(any(s <= i and i + phrase <= s + toxicity.WINDOW for s in toxicity.starts(n)) for i in range(n - phrase + 1))


def test_learning_sample_is_bounded_by_class(spark, monkeypatch):
    """Repeated ids and labels neither widen the sample nor change it."""
    given = docs(spark, [(i, f"word{i} text") for i in range(60)])
    labels = spark.range(60).selectExpr("id AS doc_id", "id % 2 AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts: seen.append(texts))
    toxicity.fit(given, labels, rows=10)
    toxicity.fit(given, labels.unionByName(labels), rows=10)
    toxicity.fit(given.unionByName(given).unionByName(given), labels, rows=10)
    assert [Counter(y for _, y in s) for s in seen] == [{0: 10, 1: 10}] * 3 and seen[0] == seen[1]


def test_toxicity_on_held_out(spark, duck):
    """Held-out rows of the middle table; the small one has too few."""
    folder = "/root/testdata/sf0.1"
    toxic = dict(duck.execute(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    got = [r for r in queries.op10_toxicity(spark, folder).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(a == b for a, b in held) >= 0.96 * len(held)
    assert sum(b for a, b in held if a) >= 0.8 * sum(a for a, _ in held)  # measured: 0.9; the larger tables give 0.99


def test_toxicity_of_odd_input(spark, odd, empty):
    mean = [(f"the garden is green today vile fool {i}".split(), 1) for i in range(40)]
    kind = [(f"the garden is green today {i}".split(), 0) for i in range(40)]
    model = toxicity.train(mean + kind)
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (1, 2, 3)) and toxicity.score(odd, model).count() == len(ODD)
    late = toxicity.score(docs(spark, [(1, "the garden is green " * 500 + "vile fool"), (2, "the garden is green " * 500)]), model).collect()
    assert [r.predicted for r in sorted(late, key=lambda r: r.doc_id)] == [1, 0]
    assert toxicity.score(empty, model).count() == 0 and {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    assert toxicity.fit(docs(spark, []), docs(spark, ODD).selectExpr("doc_id", "1 AS toxic")) is None
    assert toxicity.fit(docs(spark, ODD), docs(spark, ODD).selectExpr("doc_id", "1 AS toxic", "text")) is None
