"""Operators against plain versions of themselves, clashing columns, and layouts that no generator here has written."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from prismgraph.llm import chat, decontamination, html_crf, packing, quality, token_counts, tokens, url_filter
from prismgraph.llm.queries import vocabulary

BYTE = "byte_bpe_50k.json"


def test_long_pieces_are_counted_exactly():
    counter, lib = token_counts.counter(vocabulary(BYTE)), tokens.Encoder(vocabulary(BYTE)).library
    rng = random.Random(2)
    texts = ["".join(rng.choices(a, k=n)) for a in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "0123456789abcdef+/=", "éñ中文") for n in (511, 513, 700, 30_000)]
    texts += [" ".join(texts), "x " + "Zq" * 400_000]
    assert counter.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(map(len, counter.cache), default=0) <= tokens.CACHE_CHARS


def test_url_prefixes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "PREFIX", 1)
    rules = [("block", f"h{i}.com/p{j}") for i in range(12) for j in range(4)]
    pages = spark.createDataFrame([(i * 10 + j, f"http://www.h{i}.com/p{j}/x") for i in range(14) for j in range(6)], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()}
    assert got == {i * 10 + j: f"h{i}.com/p{j}" if i < 12 and j < 4 else None for i in range(14) for j in range(6)}
    none = url_filter.judge(pages, url_filter.rule_table(spark, []), default="allow")
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")} and none.count() == 84


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>On bees</h1><p>Bees need water, shade and a calm place.</p></article>", "old", 9)], "page_id long, url string, html string, text string, n_chars long")
    r = html_crf.extract(pages).collect()[0]
    assert (r.text, r.n_chars, set(html_crf.extract(pages).columns)) == ("On bees\n\nBees need water, shade and a calm place.", 49, {"page_id", "url", "text", "n_chars"})
    docs = spark.createDataFrame([(1, "the word and " * 3 + " ".join(f"w{i} of" for i in range(30)), 7, "x", False)], "doc_id long, text string, measured long, m string, kept boolean")
    r = quality.rate(docs).collect()[0]
    assert (r.measured, r.m, r.kept) == (7, "x", True)
    assert corpus_pipeline.quality_rules(spark, docs, "").collect() == docs.collect()


# Pages as sites write them; none of the class names stands in the training layouts' lists of article names.
SITES = [
    """<html><body><div class="gnav"><a href=/>Home</a> <a href=/news>News</a> <a href=/sport>Sport</a></div><div class="masthead-inner"><span>The Daily Post</span></div>
    <div class="l-main"><article class="c-article"><h1>Harbour works begin</h1><p class="lede">The first stones were laid on Monday, in light rain.</p><p>Workers came from three towns to help with the sea wall, which had been broken since the storm.</p>
    <h2>A long wait</h2><p>Many had asked for it for years.</p></article><aside class="rail"><h3>Most read</h3><ul><li><a href=/1>One story</a></li><li><a href=/2>Two stories</a></li></ul></aside></div>
    <footer class="site-foot"><p>&copy; 2024 The Daily Post. All rights reserved.</p></footer></body></html>""",
    """<body><header><nav><ul><li><a href="/a">Shop</a><li><a href="/b">About</a></ul></nav></header><main id=primary><h1>How to keep bees</h1><p>Bees need water, shade and patience.</p>
    <ul><li>Pick a calm place for the hive.</li><li>Check it once a week in summer.</li></ul><p>After a year there will be honey.</p></main>
    <form action=/search><label>Search</label><input name=q><button>Go</button></form><div class="cookie-consent"><p>We use cookies to make this site better.</p><button>Accept</button></div></body>""",
    """<div id=wrap><div class=navigation-bar><a href=1>Index</a><a href=2>Archive</a></div><article><header><h1>Notes from the road</h1></header><p>We left before dawn and drove north.</p><blockquote>Never trust a map, she said.</blockquote>
    <p>By noon the hills were behind us.</p><div class="advertisement"><p>Buy new tyres today!</p></div><p>The inn was closed, so we slept in the car.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><b>Ann</b><p>Great trip, thank you for writing about it.</p></div></section></div>""",
    """<html><body><table><tr><td><a href=x>start</a> <a href=y>links</a></td><td><main><h1>Old pages</h1><p>This page has looked the same since it was made.</p><p>Nobody minds.</p></main></td></tr></table>
    <div id="footer">Copyright 1999 by the author</div></body></html>""",
]
WANT = [
    ["Harbour works begin", "The first stones were laid on Monday, in light rain.", "Workers came from three towns to help with the sea wall, which had been broken since the storm.", "A long wait", "Many had asked for it for years."],
    ["How to keep bees", "Bees need water, shade and patience.", "Pick a calm place for the hive.", "Check it once a week in summer.", "After a year there will be honey."],
    ["Notes from the road", "We left before dawn and drove north.", "Never trust a map, she said.", "By noon the hills were behind us.", "The inn was closed, so we slept in the car."],
    ["Old pages", "This page has looked the same since it was made.", "Nobody minds."],
]


def test_extraction_of_sites_not_seen():
    field = html_crf.default_field()
    right = found = there = 0
    for page, want in zip(SITES, WANT, strict=True):
        got = html_crf.main_text(page, field).split("\n\n")
        right += len(set(got) & set(want))
        found += len(got)
        there += len(want)
    assert right / found >= 0.9 and right / there >= 0.9


def best_path(field, found):
    """All paths of labels, one by one."""
    score = lambda path: field.first[path[0]] + sum(sum(field.weights.get(x, 0.0) for x in f) for f, y in zip(found, path, strict=True) if y) + sum(field.pairs[a][b] for a, b in zip(path, path[1:], strict=False))
    return max(score([n >> i & 1 for i in range(len(found))]) for n in range(1 << len(found))), score


def test_viterbi_finds_the_best_path():
    rng = random.Random(1)
    for _ in range(40):
        field = html_crf.Field({f"f{i}": rng.uniform(-2, 2) for i in range(6)}, [[rng.uniform(-1, 1) for _ in "01"] for _ in "01"], [rng.uniform(-1, 1) for _ in "01"])
        found = [[f"f{i}" for i in range(6) if rng.random() < 0.4] for _ in range(rng.randint(1, 9))]
        best, score = best_path(field, found)
        assert abs(score(field.decode(found)) - best) < 1e-9


def dealt(totals, window):
    """Deficit round-robin, one window after the other, without closed forms: what each queue gives."""
    left, out = list(totals), []
    while sum(left):
        whole = sum(left)
        credits = [int(window * packing.CYCLE * x / whole) for x in left]
        for i in sorted(range(len(left)), key=lambda i: -left[i])[: window * packing.CYCLE - sum(credits)]:
            credits[i] += 1
        deficit = [0] * len(left)
        while True:
            deficit = [d + c for d, c in zip(deficit, credits, strict=True)]
            give = [max(0, d // packing.CYCLE) for d in deficit]
            rest = [d - g * packing.CYCLE for d, g in zip(deficit, give, strict=True)]
            short = window - sum(give)
            assert short >= 0
            for i in sorted(range(len(left)), key=lambda i: -rest[i])[:short]:
                give[i] += 1
                rest[i] -= packing.CYCLE
            if any(g > x for g, x in zip(give, left, strict=True)):
                break
            out.append(give)
            left, deficit = [x - g for x, g in zip(left, give, strict=True)], rest
            if not sum(left):
                return out
        first = packing.rounds(tuple(credits), packing.CYCLE, window)[1].tolist()
        give = [min(x, g) for x, g in zip(left, first, strict=True)]
        for i in sorted(range(len(left)), key=lambda i: -(left[i] - give[i])):
            give[i] += min(left[i] - give[i], window - sum(give))
        out.append(give)
        left = [x - g for x, g in zip(left, give, strict=True)]
    return out


@pytest.mark.parametrize("totals", [[1000], [700, 299, 1], [50_000, 20_000, 9_001, 3], [64] * 5, [100_000, 1]])
def test_schedule_is_the_round_robin_itself(totals):
    window = 64
    want = np.cumsum([[0] * len(totals), *dealt(totals, window)], axis=0)
    s = packing.Schedule(packing.plan(totals, window), window)
    assert (s.given(np.arange(len(want))) == want).all()


def test_chat_windows_keep_budget_spans_and_masks(spark):
    rng = random.Random(11)
    budget, history, most = 120, 40, 3
    turns = []
    for c in range(12):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * rng.randint(1, 150) + (["tool"] if c % 3 == 0 else [])
        turns += [(c, t, r, " ".join("word" for _ in range(rng.choice([0, 1, 5, 20, 60, 300 if c == 5 else 8])))) for t, r in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    windows = chat.format_windows(df, budget, history, most).collect()
    tokens_of = lambda role, text: len(regex.findall(r"\p{L}{1,6}", text)) + (2 if role in ("system", "user", "assistant") else 4)
    marks = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "tool": ("[ROLE]tool[SAYS]", "[/ROLE]")}
    for c in range(12):
        mine = [(r, x) for cc, _, r, x in turns if cc == c]
        cost = [tokens_of(*t) for t in mine]
        before = np.concatenate([[0], np.cumsum(cost)])
        system = int(mine[0][0] == "system")
        room = budget - history - (cost[0] if system else 0)
        at = 0
        for w in sorted((w for w in windows if w.conv_id == c), key=lambda w: w.window):
            segment = before[at] // (chat.SEGMENT * budget)
            end, used = at, 0
            while end < len(mine) and before[end] // (chat.SEGMENT * budget) == segment:
                n = 0 if system and end == 0 else cost[end]
                if used and used + n > room:
                    break
                end, used = end + 1, used + n
            old = [i for i in range(max(at - most, system), at) if sum(cost[i:at]) <= history] if at else []
            lead = ([0] if at and system else []) + old
            assert w.repeated == len(lead) and w.tokens == sum(cost[i] for i in [*lead, *range(at, end)])
            assert w.formatted == "".join(marks[mine[i][0]][0] + mine[i][1] + marks[mine[i][0]][1] for i in [*lead, *range(at, end)])
            assert [w.formatted[x.start : x.start + x.length] for x in w.loss] == [mine[i][1] for i in range(at, end) if mine[i][0] == "assistant"]
            assert w.tokens <= budget or end - at == 1
            at = end
        assert at == len(mine)


def test_chat_takes_a_vocabularys_own_counts(spark):
    df = spark.createDataFrame([(0, i, "user", "x", 50) for i in range(10)], "conv_id long, turn long, role string, text string, n long")
    assert sorted(w.tokens for w in chat.format_windows(df, 200, 0, tokens_col="n").collect()) == [52, 156, 156, 156]


def plain_leaks(docs, items, share=0.5):
    """Template windows as tuples of words, by trying every document with every item at every offset."""
    canon = decontamination.Canon()

    def read(text):
        _, k, n = canon.tokens(text or "")
        return k.tolist(), [canon.value[x] for x in n]

    def frame(k, words, at, width):
        kinds, some = k[at : at + width], words[at : at + width]
        enough = lambda literal: sum(literal) >= min(decontamination.LEAST, width)
        slot = [x > 0 for x in kinds] if enough([x == 0 for x in kinds]) else [x in (1, 2) for x in kinds]
        shape = tuple(x if not s else i for x, s, i in zip(some, slot, kinds, strict=True))
        return shape if enough([not s for s in slot]) else None, slot, tuple(some)

    out = {}
    for d, text in docs:
        kd, wd = read(text)
        for i, item in items:
            ki, wi = read(item)
            if not decontamination._searchable(wi):
                continue
            width = min(decontamination.WIDTH, len(wi))
            n = len(wi) - width + 1
            theirs = [frame(ki, wi, a, width) for a in range(n)]
            ours = [frame(kd, wd, a, width) for a in range(len(wd) - width + 1)]
            met = set()
            for off in range(-n, len(ours)):
                same = [(a, theirs[a], ours[a + off]) for a in range(n) if 0 <= a + off < len(ours)]
                met |= {a for a, x, y in same if x[2] == y[2]}
                alike = [(a, [(a + j, wi[a + j], wd[a + off + j]) for j in range(width) if x[1][j]]) for a, x, y in same if x[0] is not None and x[0] == y[0]]
                held = {p: (b, c) for _, some in alike for p, b, c in some}
                votes, left = Counter(held.values()), Counter(b for b, _ in held.values())
                met |= {a for a, some in alike if all(2 * votes[b, c] > left[b] for _, b, c in some)}
            framed = {a for a in range(n) if theirs[a][0] is not None}
            if len(met) >= share * n or framed and len(met & framed) >= share * len(framed):
                out.setdefault(d, set()).add(i)
    return out


UNIT_WORDS = {"en": "minutes kg miles hours".split(), "fr": "minutes heures mètres semaines".split(), "es": "horas kilómetros semanas años".split(), "de": "Stunden Tage Wochen Jahre".split()}


def questions(rng, lang, n):
    """Questions as functions of their parameters: words, distinct numbers, units (of one kind or two, whatever they are) and names."""
    syllables = "ba ke to mi ru lo sa ne pi du".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    out = []
    for _ in range(n):
        shape = [rng.choice("wwwwwwwwnun" if lang == "en" else "wwwwwwwwnu") for _ in range(rng.randint(14, 40))]
        words = [(word().capitalize() if lang == "de" and rng.random() < 0.35 else word()) if s == "w" else s for s in shape]

        def make(words=words, lang=lang):
            names = {}
            units, numbers = rng.sample(UNIT_WORDS[lang], 2), iter(rng.sample(range(2, 999), 40))
            filled = []
            for i, w in enumerate(words):
                if w == "n":
                    filled.append(str(next(numbers)))
                elif w == "u":
                    filled.append(f"{next(numbers)} {units[i % 2]}")
                elif lang == "en" and i % 9 == 4:
                    filled.append(names.setdefault(i % 2, word().capitalize()))
                else:
                    filled.append(w)
            text = " ".join(filled)
            return text[0].upper() + text[1:] + "?"

        out.append(make)
    return out


def test_reparameterised_questions(spark):
    """Of questions that come back with other numbers, units and names, at least nine in ten; and no clean document."""
    rng = random.Random(12)
    makers = [q for lang in UNIT_WORDS for q in questions(rng, lang, 15)]
    items = [(i, q()) for i, q in enumerate(makers)]
    clean = [q() for lang in UNIT_WORDS for q in questions(rng, lang, 15)]
    docs = [(i, f"Some text before. {q()} And text after it.") for i, q in enumerate(makers)] + [(1000 + i, t) for i, t in enumerate(clean)]
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r.item_id for r in found.collect() if r.contaminated}
    assert not [d for d in got if d >= 1000]
    assert sum(got.get(i) == i for i in range(len(makers))) >= 0.9 * len(makers)


def test_leaks_as_a_plain_search_finds_them(spark):
    rng = random.Random(13)
    makers = [q for lang in UNIT_WORDS for q in questions(rng, lang, 4)]
    items = [(i, q()) for i, q in enumerate(makers)] + [(90, None), (91, "What is 17 times 23?"), (92, "Yes")]
    texts = [q() for q in makers] + [t for _, t in items[:6]] + [None, "", "What is 17 times 23?", "What is 18 times 23?"]
    for t in items[:8]:  # parts of items, and items with a word changed
        w = t[1].split()
        texts.append("Before it. " + " ".join(w[: len(w) // 2]))
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id for r in found.collect() if r.contaminated}
    assert got == set(plain_leaks(docs, items))


def plain_kept(text):
    """The quality verdict, rule by rule."""
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    if len(w) < 10 or 100 * len(covered) > 20 * len(w):
        return False
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    stop = {y for x in quality.STOP_WORDS for y in (x, x.capitalize())}
    values = {
        "mean_word_length": sum(map(len, w)) / len(w),
        "symbols_per_word": sum(c in "#*$%&|<>" for c in text) / len(w),
        "exclamations_per_word": text.count("!") / len(w),
        "upper_case_words": sum(bool(regex.fullmatch(r"\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*", x)) for x in w) / len(w),
        "stop_words": sum(x in stop for x in w) / len(w),
        "duplicate_lines": (len(lines) - len(set(lines))) / len(lines) if lines else 0,
    }
    return all(len(w) < since or ((lo is None or values[name] >= lo) and (hi is None or values[name] <= hi)) for name, lo, hi, since in quality.THRESHOLDS)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(14)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(["the", "of", "and", *rng.sample(vocab, 8)]) for _ in range(n)) + rng.choice([".", "!", "\nA line.\nA line.", " # $ %"])
    texts = [text(rng.choice([3, 12, 40, 90])) for _ in range(50)]
    texts += texts[:12] + [None, "", "spam spam " * 30, "THE OF AND " * 12 + text(20)]
    for t in texts[5:25]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    items = [(i, text(14)) for i in range(5)] + [(5, "Who wrote Hamlet?")]
    texts += [text(30) + " " + items[2][1], "Who wrote Hamlet? " + text(40)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # the stages, one after the other, without any of their means
    kept = [(i, t) for i, t, *_ in rows if plain_kept(t)]
    sets = {}
    for i, t in kept:
        w = [x for x in re.split("[ \t-\r]+", t.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] > label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    kept = [(i, t) for i, t in kept if label[i] == i]
    leaks = plain_leaks(kept, items)
    kept = {i: t for i, t in kept if i not in leaks}
    assert 20 < len(kept) < 60 and leaks
    lib = tokens.Encoder(vocabulary(BYTE)).library
    want = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in kept.items()}
    got = corpus_pipeline.run(spark, d).collect()
    assert {p.doc_id for p in got} == set(want)
    filled = {}
    for p in got:
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) and p.doc_tokens == len(want[p.doc_id]) // 4
        filled.setdefault(p.doc_id, []).append((p.start, p.length))
    assert all(sum(n for _, n in v) == len(want[i]) // 4 and len({s for s, _ in v}) == len(v) for i, v in filled.items())
    taken = sorted((p.sequence_id * 1024 + p.offset, p.length) for p in got)
    assert [a for a, _ in taken] == [0, *np.cumsum([n for _, n in taken])[:-1].tolist()]
    # of each whole window, the sources' shares
    of = {i: s for i, _, _, s, _ in rows}
    share = Counter()
    for p in got:
        share[of[p.doc_id]] += p.length
    first = Counter()
    for p in got:
        if p.sequence_id == 0:
            first[of[p.doc_id]] += p.length
    assert all(abs(first[s] / 1024 - share[s] / sum(share.values())) < 0.01 for s in share)


def test_columns_with_nulls_only(spark):
    docs = spark.range(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"))
    assert token_counts.count_tokens(docs, vocabulary(BYTE)).select("n_tokens").distinct().collect()[0].n_tokens == 0
    assert packing.pack(docs, vocabulary(BYTE)).count() == 3
    assert decontamination.find_leaks(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).where("contaminated").count() == 0
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text")
    assert chat.read_back(chat.format_windows(turns)).collect()[0].n_turns == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert {r.text for r in html_crf.extract(pages).collect()} == {""}
