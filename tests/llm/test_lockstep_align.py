import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playtrace.llm import lockstep_align as la


def load():
    with open(f"{la.FOLDER}/{la.A_FILE}", "rb") as a, open(f"{la.FOLDER}/{la.B_FILE}", "rb") as b:
        return la.Tokens(a.read(), b.read())


TOKENS = load()


def ends(ids, names):
    at, out = 0, []
    for i in ids:
        at += len(names[i])
        out.append(at)
    return out


def brute(text):
    """Ids of A, of B, links and groups of a text that is encoded whole."""
    if not text:
        return [], [], [], ""
    a = TOKENS.a.encode(" " + text, add_special_tokens=False).ids
    b = TOKENS.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(TOKENS.a_bytes[i] for i in a) != raw or b"".join(TOKENS.b_bytes[i] for i in b) != raw:
        return [], [], [], ""
    a_ends, b_ends = ends(a, TOKENS.a_bytes), ends(b, TOKENS.b_bytes)
    links, groups, i, j = [], [], 0, 0
    for x, end in enumerate(a_ends):
        if end in b_ends:
            y = b_ends.index(end)
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
    return a, b, links, ";".join(groups)


def aligned(texts):
    n_a, n_b, n, groups, place, a, b, times = la.align(TOKENS, texts)
    for i in range(len(texts)):
        pairs = Counter()
        for x, y, z in zip(a[place[i] : place[i + 1]], b[place[i] : place[i + 1]], times[place[i] : place[i + 1]]):
            pairs[int(x), int(y)] += int(z)
        yield int(n_a[i]), int(n_b[i]), int(n[i]), groups[i].decode(), pairs


def check(texts):
    for text, got in zip(texts, aligned(texts)):
        a, b, links, groups = brute(text)
        assert got == (len(a), len(b), len(links), groups, Counter(links)), text


ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "x\t y \n z", "</s><s>[INST] <|endoftext|> <unk>", "it's we'll I'M 'sx",
    "x▁y ▁ z", "日本語 テキスト", "é à ü ß", "👩‍👩‍👧 ok", "1 22 333 4,444.5", "nul\x00 in", "a b   c　d \x85 \x1c e",
    "é combining ́ x", "\r\n a\r\n\r\nb", "<0x41> <s>", "trailing \n", "word " * 50,
]


def test_odd_texts():
    TOKENS.clear()
    check(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁.'s1 \n\t  日👩́<>"), max_size=40), max_size=6))
def test_any_text(texts):
    check(texts)


@pytest.mark.parametrize("lane", [1, 7])
def test_lanes_of_a_long_text(monkeypatch, lane):
    monkeypatch.setattr(la, "LANE", lane)
    rng = random.Random(4)
    words = ["the", "under", "stand", "ing.", "Größe", "\n", "x1", "don't", "éa"]
    check([" ".join(rng.choice(words) for _ in range(300)), None, "short one", " ".join(words)])


def test_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(la, "MAX_PARTS", 3)
    for _ in range(3):
        check(["one two three four", "five one six"])
    assert len(TOKENS.number) <= 7


def totals(rows):
    links = [(doc, pair) for doc, text in rows for pair in brute(text)[2]]
    held = Counter(pair for _, pair in links)
    top = defaultdict(int)
    for (_, b), n in held.items():
        top[b] = max(top[b], n)
    best, total = Counter(), Counter()
    for doc, pair in links:
        best[doc] += held[pair] == top[pair[1]]
        total[doc] += held[pair]
    return best, total


@pytest.mark.parametrize("most", [1_000_000, 20, 0])
def test_equals_brute_force(spark, most):
    rng = random.Random(9)
    words = "the of understanding Unter scheiden été antidisestablishment x1 99 don't ing. <s>".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    rows = [*enumerate([*texts, *ODD])]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n_a int, k int").repartition(4)
    got = {r.k: r for r in la.token_links(docs, max_pairs=most).collect()}
    best, total = totals(rows)
    assert set(got) == {k for k, _ in rows}
    for k, text in rows:
        a, b, links, groups = brute(text)
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(links), len(links))
        assert (r.n_best, r.count_sum) == (best[k], total[k])
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if a else "")


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "one text"), (1, "one text"), (1, "one text"), (2, None)]
    got = la.token_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    assert {r.count_sum for r in got if r.k != 2} == {3 * got[0].n_links or 3 * got[1].n_links}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert la.token_links(empty).collect() == []


def test_best_id_of_each_token(spark):
    rows = la.saved(la.aligned(spark.createDataFrame([(1, "the the thee")], "doc_id long, text string")))
    got = {r.b: (r.a, r.held) for r in la.vocabulary_links(la.pair_counts(rows)).collect()}
    the = TOKENS.b.encode("the")[0]
    assert got[the] == (TOKENS.a.encode(" the", add_special_tokens=False).ids[0], 2)
