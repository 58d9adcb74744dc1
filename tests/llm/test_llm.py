"""The operators against brute force, exact round trips and held-out pages, on small tables with awkward rows."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismgraph.llm import bitplane, chat, decontamination, html_crf, jaccard, packing, quality, resharding, token_counts, tokens, url_filter
from prismgraph.llm.queries import RULES, vocabulary

WORDS = "la mer et the storm ofereinst ñandú über élan hat AND Of 17 3,5 don't x".split()
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    return tokens.Encoder(vocabulary(name)).library


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ". ", "\n", "  ", ", "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c d", "A b C d", "x  <|endoftext|> y", "中文 текст ع", "e\u0301 \x1c \u2003 z", "word " * 3000, "!" * 500]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += texts[20:40]  # exact copies
    for t in texts[30:50]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    out = [(i, t, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(t or "")) for i, t in enumerate(texts)]
    out[12] = (12, out[12][1], "en", None, 0)
    return out + [(None, "no id here at all but some words", "en", "s1", 1), (3, "one", "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # other columns, with names that operators use inside, must not matter
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return df.withColumns({"key": F.lit("k"), "tie": F.lit(1), "hits": F.lit(2), "rep": F.lit(3), "block": F.lit(4), "size": F.lit("z"), "m": F.lit(0)})


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_units_are_the_librarys(name):
    rng = random.Random(1)
    enc = tokens.Encoder(vocabulary(name))
    letters = "abcXYZ  \n\t'.,!_%19éÉßñÑ²½–—“”…ªº×÷İ́中\x1c\r"
    texts = ["".join(rng.choice(letters[: rng.choice([15, 30, len(letters)])]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = enc.library.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(enc.encode(texts), want, strict=True))


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes(mode):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
        assert (bitplane.from_planes(bitplane.to_planes(ids, mode), n) == ids).all()
    assert bitplane.combine_crc(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_ids_file(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    bitplane.write_ids(docs, path, vocabulary(WORD), block=64)  # documents over many blocks
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in bitplane.documents_of(bitplane.read_ids(spark, path)).collect())
    lib, start = library(WORD), 0
    assert [g[1] for g in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    by_id = {}
    for r in rows:
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]
        by_id.setdefault(-1 if r[0] is None else r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for s, d, n, crc in got:
        assert s == start and (n, crc) in by_id[d]
        start += n


def test_token_counts(docs, rows):
    lib = library(BYTE)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, vocabulary(BYTE)).collect())
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 1024) for r in rows)
    assert token_counts.counter(vocabulary(BYTE)).symbols([b"a" * 4000, b"aaa"]).tolist() == [n("a" * 4000), n("aaa")]


@pytest.mark.parametrize("targets", [None, {"s0": 0.5, "s1": 0.25, "s2": 0.25}])
def test_packing(docs, rows, targets):
    got = packing.pack(docs, vocabulary(BYTE), window=64, targets=targets).collect()
    lib = library(BYTE)
    want = sorted((-1 if r[0] is None else r[0], np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    seqs = {}
    for p in got:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, pieces in seqs.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    whole = {}
    for p in sorted(got, key=lambda p: p.start):
        if p.doc_id not in (3, None):
            assert len(whole.get(p.doc_id, b"")) == 4 * p.start
            whole[p.doc_id] = whole.get(p.doc_id, b"") + bytes(p.ids)
    assert sorted(whole.items()) == [w for w in want if w[0] not in (3, -1)]
    assert sum(p.length for p in got) == sum(len(w[1]) // 4 for w in want)


def test_rounds_keep_proportions():
    phases = packing.plan([700_000, 200_000, 99_000, 1_000, 1], 1024)
    s = packing.Schedule(phases, 1024)
    w = np.arange(0, 1_000_001 // 1024 + 1)
    given = s.given(w)
    assert (np.diff(given, axis=0) >= 0).all() and (given.sum(axis=1) == w * 1024).all()
    share = given[1:-3] / given[1:-3].sum(axis=1, keepdims=True)
    assert abs(share[100:] - np.array([0.7, 0.2, 0.099, 0.001, 0])).max() < 0.001


def test_many_sources_keep_proportions():
    amounts = sorted([50_000] * 3 + [700 + 7 * i for i in range(60)] + [3], reverse=True)
    window, n = 256, sum(amounts)
    made = packing.tree(amounts, window, None, 4)
    assert max(len(s.phases[0].credits) for s in made.schedules) <= 4
    slots, late = [], []
    for i, x in enumerate(amounts):
        at, w, slot, length = made.cut(i, 0, x)
        assert (at == np.cumsum(length) - length).all() and length.sum() == x
        slots += [np.arange(a, a + k) for a, k in zip(w * window + slot, length, strict=True)]
        if x > 600:  # in every part of the windows, its share
            part = np.bincount(w * 8 // (n // window + 1), weights=length, minlength=8) / x
            late.append(abs(part - 0.125).max())
    assert (np.sort(np.concatenate(slots)) == np.arange(n)).all() and max(late) < 0.02


@pytest.mark.parametrize("targets", [None, {"s2": 0.75, "s1": 0.25}])
def test_packing_with_more_sources_than_queues(docs, rows, targets):
    got = packing.pack(docs, vocabulary(BYTE), window=64, targets=targets, max_queues=2).collect()
    lengths = {}
    taken = sorted((p.sequence_id * 64 + p.offset, p.length) for p in got)
    assert [a for a, _ in taken] == [0, *np.cumsum([n for _, n in taken])[:-1].tolist()]
    for p in got:
        lengths.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert all(sum(n for _, n, _ in v) == v[0][2] for d, v in lengths.items() if d not in (3, None))
    if targets:
        of = {r[0]: r[3] for r in rows if r[0] not in (3, None)}
        first = {s: sum(p.length for p in got if p.sequence_id == 1 and of.get(p.doc_id) == s) for s in ("s0", "s1", "s2")}
        assert first["s0"] == 0 and first["s1"] > 8 and first["s2"] > 40


def test_resharding(spark, docs, rows):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    old = resharding.lay_out(docs.withColumnRenamed("size", "Shard"), 3, size, min_blocks=24)
    paths = {f[0] for f in old.files}
    assert all(os.path.exists(p[7:]) for p in paths)
    times = {p: os.stat(p[7:]).st_mtime_ns for p in paths}
    supply = [sum(f[4] for f in old.files if f[1] == s) for s in range(3)]
    new, report = resharding.reshard(old, 5)
    # the fewest bytes: all of the surplus over an equal share, and no more
    cap = resharding.even_capacities(sum(supply), 5)
    assert report["bytes_moved"] == sum(max(0, s - c) for s, c in zip(supply, cap, strict=False))
    # files that stay are untouched, replaced ones are gone, and the manifest is what is there
    kept = {f[0] for f in new.files} & paths
    assert len(kept) == report["files_kept"] > 0 and all(os.stat(p[7:]).st_mtime_ns == times[p] for p in kept)
    assert not any(os.path.exists(p[7:]) for p in paths - kept) and all(os.path.exists(f[0][7:]) for f in new.files)
    moved = sum(1 for r in old.spark.read.schema(new.schema).parquet(*[f[0] for f in new.files if f[0] not in paths]).collect() if r._shard != r.old_shard)
    got = new.slots().collect()
    assert moved == sum(1 for r in got if r._shard != r.old_shard) > 0
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    assert sorted(map(key, got)) == sorted(key({"doc_id": r[0], "text": r[1]}) for r in rows) and {r.Shard for r in got} == {"z"}
    largest = max(r["size"] for r in got)
    for s in range(5):
        mine = [r for r in got if r._shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - cap[s]) <= largest
        assert sum(f[4] for f in new.files if f[1] == s) == sum(r["size"] for r in mine)
    again, report = resharding.reshard(new, 5, capacity=[sum(f[4] for f in new.files if f[1] == s) for s in range(5)])
    assert report["bytes_moved"] == report["files_replaced"] == 0 and sorted(again.files) == sorted(new.files)


def test_flow_moves_least():
    rng = random.Random(3)
    for _ in range(200):
        supply = [rng.randint(0, 100) for _ in range(rng.randint(1, 6))]
        cap = resharding.even_capacities(sum(supply), rng.randint(1, 6))
        if rng.random() < 0.5:
            cap = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
            cap[0] += max(0, sum(supply) - sum(cap))
        flow = resharding.min_cost_flow(supply, cap)
        for i, s in enumerate(supply):
            assert sum(v for (a, _), v in flow.items() if a == i) == s
        assert all(sum(v for (_, b), v in flow.items() if b == j) <= c for j, c in enumerate(cap))
        stays = sum(min(s, cap[i]) for i, s in enumerate(supply) if i < len(cap))
        assert sum(v for (a, b), v in flow.items() if a != b) == sum(supply) - stays


def test_flow_of_any_network():
    """Against all ways to send, on small networks with prices."""
    rng = random.Random(4)
    for _ in range(60):
        arcs = [(a, b, rng.randint(0, 2), rng.randint(0, 3)) for a in range(4) for b in range(4) if a != b and rng.random() < 0.5]
        flow = resharding.cheapest_flow(4, arcs, 0, 3)
        value = lambda f: sum(x for x, (a, *_) in zip(f, arcs, strict=True) if a == 0) - sum(x for x, (_, b, *_) in zip(f, arcs, strict=True) if b == 0)  # noqa: E731, B023
        price = lambda f: sum(x * c for x, (*_, c) in zip(f, arcs, strict=True))  # noqa: E731, B023
        even = lambda f: all(sum(x for x, (a, *_) in zip(f, arcs, strict=True) if a == n) == sum(x for x, (_, b, *_) in zip(f, arcs, strict=True) if b == n) for n in (1, 2))  # noqa: E731, B023
        ways = [f for f in itertools.product(*[range(r + 1) for *_, r, _ in arcs]) if even(f)]
        assert even(flow) and (-value(flow), price(flow)) == min((-value(f), price(f)) for f in ways)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/7x?q", "https://a.b.example.com/en/9", "x://com/en/", "http://notcom/en/", "http://net/de/8", "http://q.example.net/de/81#f", "http://org", "http://u.org/es", "http://a://b.org/es/", "http://.org/es/1", "http://EXAMPLE.com"]
    pages = spark.createDataFrame([(i % 3, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge(pages, url_filter.rule_table(spark, RULES)).collect())
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        want.append((i % 3, host, path, max(fits)[1] if fits else "", max(fits)[2] if fits else "allow"))
    assert got == sorted(want)


def test_chat(spark):
    rng = random.Random(2)
    turns = []
    for c in range(25):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(1, 40)
        for t, role in enumerate(roles):
            text = rng.choice([None, "", r"a [INST] <\s> [\INST] </s> [\\/SYS]", "[ANS", "</s>[INST] ok [/INST]", "é" * rng.randint(0, 3000), "line\nline " * rng.randint(1, 60)])
            turns.append((c, t, "tool[SAYS]" if c == 7 and t == 2 else role, text))
    turns += [(None, 0, None, "alone"), (99, 0, "system", "only a system turn"), (99, 0, "system", "only a system turn")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat.format_windows(df)
    budget = chat_cost = {}
    for w in windows.collect():
        budget.setdefault(w.conv_id, []).append(w)
    assert any(len(v) > 2 for v in chat_cost.values()) and any(w.repeated > 1 for v in chat_cost.values() for w in v)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {t[0] for t in turns}:
        mine = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        learnt = "".join(x for _, r, x in mine if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.formatted) for w in chat_cost[c])


def test_quality(docs, rows):
    got = {(r.doc_id, r.text): r for r in quality.rate(docs).collect()}
    for d, text, *_ in rows:
        w = [x for x in re.split("[ \t-\r]+", text or "") if x]
        lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 500 else set(range(len(w)))
        r = got[(d, text)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_jaccard(docs, rows):
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.join_documents(docs).collect())
    sets = {}
    for d, text, *_ in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.setdefault(d, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]))
    label = {d: d for d in sets if d is not None}
    for _ in label:
        for a in label:
            for b in label:
                if sets[a] and sets[b] and label[a] > label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b]
    want = sorted((-1, 0, -1) if r[0] is None else (r[0], len(sets[r[0]]), label[r[0]]) for r in rows)
    assert [g for g in got if g[0] >= 0] == [w for w in want if w[0] >= 0] and got[0][2] == -1


def test_jaccard_in_blocks(spark, monkeypatch):
    """A large group, verified in blocks and their pairs, and long lists as stars."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.randint(45, 60)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join_documents(df).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert [got[i] for i in range(len(texts))] == label


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ke", "to", "mi", "ru"]) for _ in range(4))
    filler = lambda n: " ".join(word() for _ in range(n))
    q = "A farmer sold 12 baskets to Maria for 30 dollars and then Maria gave 12 of them back to the old market"
    items = [(0, q), (1, "Short " + filler(5)), (2, None), (3, ""), (4, filler(40)), (5, q.replace("12", "40"))]
    same = q.replace("12", "7").replace("Maria", "Pedro").replace("30", "55")
    broken = "A farmer sold 7 baskets to Pedro for 7 dollars and then Anna gave 9 of them back to the old market"
    texts = [(0, filler(30) + ". " + q + ". " + filler(30)), (1, same), (2, broken), (3, filler(80)), (4, None), (5, ""), (6, filler(9) + ". " + items[1][1]), (7, items[4][1].upper()), (8, q[:40]), (8, same)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.contaminated, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(0, True, 0), (1, True, 0), (2, False, None), (3, False, None), (4, False, None), (5, False, None), (6, True, 1), (7, True, 4), (8, False, None), (8, True, 0)], key=str)
    assert not any(r.contaminated for r in decontamination.find_leaks(docs, bench.limit(0)).collect())


def test_items_of_one_template(spark):
    q = "A farmer sold {} baskets at the market and then gave {} of them back to the old baker next door"
    bench = spark.createDataFrame([(0, q.format(12, 12)), (1, q.format(8, 3)), (2, q.format(9, 4))], "item_id long, text string")
    docs = spark.createDataFrame([(0, q.format(8, 3)), (1, q.format(7, 7)), (2, q.format(9, 4))], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (True, 1)}


def test_items_of_few_literal_words(spark):
    items = ["What is 17 times 23?", "Who wrote Hamlet?", "Did Anna Marie Smith Meet John Paul Jones In Old York Town", "红楼梦的作者是谁?他生活在哪个朝代", "ใครเป็นผู้แต่งเรื่องนี้", "Yes", "1 2 3", "Count 12 13 14 15 16 17 18 and 19 20 21 22 23 24"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"some words before. {x} and words after it" for x in items[:3]] + [f"前面的文字{items[3]}后面的文字", f"คำ{items[4]}คำ"] + ["Yes 1 2 3 of course"] + ["x " + items[7], "What is 18 times 23?", "红楼梦是书", "Count 12 13 14 of them"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with pytest.warns(UserWarning, match="2 benchmark items"):
        got = {r.doc_id: r.item_id for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {**{i: i for i in range(5)}, 5: None, 6: 7, 7: None, 8: None, 9: None}
    assert sorted(r.item_id for r in decontamination.unsearchable(bench).collect()) == [5, 6]


def test_near_copies_of_long_items(spark):
    rng = random.Random(9)
    filler = lambda: " ".join("".join(rng.choice(["ba", "ke", "to", "mi", "ru"]) for _ in range(4)) for _ in range(9))
    item = " ".join(f"{filler()} then Maria took 12 of them" for _ in range(5))
    last = lambda a, b, t: b.join(t.rsplit(a, 1))
    other = item.replace("Maria", "Pedro").replace("12", "7")
    twice = "one sold 12 of the red and old hats to the man who then gave 12 of the hats to the boy at the old gate and went on his way to the sea"
    texts = [last("Maria", "Marta", item), last("12", "13", item), last("12", "13", last("Maria", "Marta", item)), other, last("7", "8", other), last("12", "13", twice)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, twice)], "item_id long, text string")
    assert {r.doc_id: r.item_id for r in decontamination.find_leaks(docs, bench).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_extraction(spark):
    field = html_crf.default_field()
    wrong = total = 0
    for page, texts in html_crf.labelled_pages(150, seed=1234):
        x, y = html_crf.labelled(page, texts)
        wrong += sum(a != b for a, b in zip(y, field.decode(x), strict=True))
        total += len(y)
    assert wrong < 0.01 * total
    awkward = [None, "", "<<<", "<p", "<!-- open", "<script>never closed", "plain", "</div></p>", "<article><p>a&amp;b &#233; &nope; x<br>y</article>", "<article>" + "<p>one two three.</p>" * 5000 + "</article>"]
    pages = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(awkward)], "page_id long, url string, html string, lang string")
    got = {r.page_id: r.text for r in html_crf.extract(pages, field).collect()}
    assert got[0] == got[1] == got[4] == got[5] == "" and got[8] == "a&b é &nope; x y" and got[9].count("one two three.") == 5000


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<svg-icon name=x></svg-icon><p>a b</p><svg><text>no</text></svg><p>c</p>", ["a b", "c"]),
        ("<title-card>t</title-card><select-box></select-box><style-guide></style-guide><p>a</p>", ["t", "a"]),
        ("<svg class=i/><p>a</p><svg/>b", ["a", "b"]),
        ("<svg class=i><p>a</p><svg><svg><text>no</text></svg><text>no</text></svg><p>b</p></svg>c", ["a", "b", "c"]),
        ("<object data=x><p>a</p><template><p>b</p><select><option>c<p>d</p>", ["a", "b", "c", "d"]),
        ("<object><p>no</p></object><template><p>no</p></template><select><option>no</select><p>a</p>", ["a"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <noscript>be <b>so</b></noscript></p><math/><p>a</p>", ["let x=2 be so", "a"]),
        ("<iframe src=x /><p>a</p><title><p>b</p><textarea><p>c</p>", ["a", "b", "c"]),
        ("<script>'<p>no</p>'</script foo><p>a</p><textarea><p>no <!-- \"</textarea><p>b</p><style><p>no", ["a", "b"]),
    ],
)
def test_leaf_blocks_hold_the_page(page, want):
    assert [b[0] for b in html_crf.leaf_blocks(f"<article>{page}</article>")] == want


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    bitplane.write_ids(none, f"file://{tmp_path}/none", vocabulary(WORD))
    assert bitplane.documents_of(bitplane.read_ids(spark, f"file://{tmp_path}/none")).count() == 0
    assert packing.pack(none, vocabulary(BYTE)).count() == 0
    assert token_counts.count_tokens(none, vocabulary(BYTE)).count() == 0
    assert jaccard.join_documents(none).count() == 0
    assert resharding.reshard(resharding.lay_out(none, 3, F.lit(8)), 5)[0].slots().count() == 0
    assert quality.rate(none).count() == 0
    pages = none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert html_crf.extract(pages).count() == url_filter.judge(pages, url_filter.rule_table(spark, RULES)).count() == 0
    turns = none.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")
    windows = chat.format_windows(turns)
    assert windows.count() == chat.read_back(windows).count() == 0
    bench = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert decontamination.find_leaks(none, bench).count() == decontamination.find_leaks(none, bench.limit(0)).count() == 0
    d = f"file://{tmp_path}"
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(["the", "of", "and", *rng.sample(vocab, 8)]) for _ in range(n)) + "."
    clean = [text(60) for _ in range(8)]
    leak = text(25)
    all_ = [*clean, clean[0], clean[1].replace(" of ", " off ", 1), "spam spam " * 40, "#*$ " * 50, None, text(20) + " " + leak]
    docs = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(all_)]
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, d).collect()}) == list(range(8))
