"""Leaked evaluation texts in many forms, and against brute force."""

import random

import pytest

from sextant.llm import leaks
from sextant.llm.words import words

R = random.Random(5)
VOCABULARY = [f"{a}{b}{c}" for a in ("mor", "tel", "vin", "sal", "quar") for b in ("an", "ep", "o", "ud") for c in ("dle", "ton", "rix", "se", "ma")]
OPENING = "Read the short program below with care and answer the question that follows it in one line only."
ITEM = "The inner_ticket of tomodel_25 short-circuits once its speculative permutation exceeds 31, so decide whether the counter held by hukefil survives 88 further iterations of the outer loop and which station it prints at the very end."
FORMS = {
    "as it is": lambda t: t,
    "upper case": str.upper,
    "wrapped in a comment": lambda t: "\n".join("# " + x for x in wrap(t)),
    "numbered lines": lambda t: "\n".join(f"{i}: {x}" for i, x in enumerate(wrap(t), 50)),
    "numbered with bars": lambda t: "\n".join(f" {i} | {x}" for i, x in enumerate(wrap(t), 8)),
    "quoted": lambda t: "\n".join("> " + x for x in wrap(t)),
    "odd blanks": lambda t: t.replace(" ", " ​\t", 4).replace(" ", " ", 3),
    "markup": lambda t: "<p>" + t.replace("whether", "<b>whether</b>").replace(" ", "&nbsp;", 5) + "</p>",
    "emphasis": lambda t: t.replace("counter", "**counter**").replace("outer", "*outer*"),
    "look-alikes": lambda t: t.replace("o", "о").replace("e", "е"),
    "hyphenated": lambda t: t.replace("permutation", "permu-\ntation").replace("iterations", "itera­tions"),
    "escaped": lambda t: t.replace("_", "\\_"),
    "wide letters": lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t),
}


def wrap(t, n=7):
    w = t.split()
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


def run(spark, docs, items, find=None, **options):
    d = spark.createDataFrame([(*x, "i") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.words for r in (find or leaks.leaked_items)(d, i, **options).collect()}


def test_forms(spark):
    docs = [(k, f"Some text before.\n{f(ITEM)}\nSome text after.") for k, f in enumerate(FORMS.values())]
    assert {names[0] for names in run(spark, docs, [(1, ITEM)])} == set(range(len(FORMS)))


def test_what_is_no_leak(spark):
    w = ITEM.split()
    shuffled = w[:]
    R.shuffle(shuffled)
    changed = [x if i % 5 else "other" for i, x in enumerate(w)]
    docs = [(1, " ".join(w[:15])), (2, " ".join(shuffled)), (3, " ".join(changed)), (4, OPENING + " " + " ".join(w[:12])), (5, " ".join(w[:9]) + " cut " + " ".join(w[12:21])), (6, None), (7, ""), (None, ITEM), (8, " ".join(w[:11]) + " cut " + " ".join(w[14:26]))]
    items = [(1, OPENING + " " + ITEM), (2, OPENING + " Something else entirely is asked for in this one, namely the name of the last garden."), (3, None), (None, ITEM), (4, "too short")]
    assert set(run(spark, docs, items)) == {(8, 1)}


def test_equal_items_do_not_hide_each_other(spark):
    assert set(run(spark, [(1, ITEM)], [(1, ITEM), (2, ITEM)])) == {(1, 1), (1, 2)}


def plain_table(items, shared=leaks.SHARED, run=leaks.RUN):
    """The item table by comparing every two items."""
    w = {i: words(t) for i, t in items}

    def longest(i, p):
        best = 0
        for j, v in w.items():
            if v != w[i]:
                for q in range(len(v)):
                    n = 0
                    while p + n < len(w[i]) and q + n < len(v) and w[i][p + n] == v[q + n]:
                        n += 1
                    best = max(best, n)
        return best if best >= run else 0

    out = {}
    for i in w:
        theirs = [longest(i, p) for p in range(len(w[i]))] + [0]
        out[i] = (w[i], theirs, {q for p, n in enumerate(theirs) if n >= shared for q in range(p, p + n)})
    return out


def sample(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(VOCABULARY) for _ in range(r.randrange(5, 60)))) for i in range(12)]
    # items that share wording of different lengths, repeat themselves, or are equal
    a, b = items[0][1].split(), items[1][1].split()
    items += [(20, " ".join(a[:14] + b[:9] + a[:14])), (21, " ".join(b[3:14] + a[2:16])), (22, items[2][1]), (23, " ".join(a[:9] * 3))]
    docs = []
    for k in range(60):
        t = [r.choice(VOCABULARY) for _ in range(r.randrange(10, 80))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            p = r.randrange(len(t))
            t[p:p] = w[a : a + r.randrange(1, 40)]
        docs.append((k, " ".join(t)))
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_item_table(spark, seed):
    _, items = sample(seed)
    got = {r.item: (list(r.words), list(r.theirs) or [0] * (len(r.words) + 1), set(r.common)) for r in leaks.item_table(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert got == plain_table(items)


@pytest.mark.parametrize(("seed", "options", "broadcast"), [(0, {}, 1000), (1, {"part_chars": 600}, 1000), (1, {}, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, options, broadcast):
    monkeypatch.setattr(leaks, "MAX_BROADCAST_DOCS", broadcast)
    docs, items = sample(seed)
    c = leaks.Checker(plain_table(items))
    want = {(k, i): n for k, t in docs for i, _ in items if (n := c.count(words(t), i, range(-200, 200))) >= 20}
    assert run(spark, docs, items, **options) == want and want


@pytest.mark.parametrize("options", [{}, {"part_chars": 500}])
def test_proximity_equals_brute_force(spark, options):
    docs, items = sample(3)
    r = random.Random(3)
    for k, (_, t) in enumerate(items[:6]):
        w = t.split()
        r.shuffle(w)
        docs.append((100 + k, " ".join(x for y in w for x in (y, "filler"))))
    df = {}
    for _, t in docs:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    rare = leaks.rarest({i: words(t) for i, t in items}, df)
    want = {}
    for k, t in docs:
        w = words(t)
        for i, text in items:
            span = leaks.WITHIN * len(words(text))
            n = max((len(set(w[p : p + span]) & set(rare[i])) for p in range(len(w))), default=0)
            if n >= leaks.NEAR:
                want[k, i] = n
    assert run(spark, docs, items, leaks.near_items, **options) == want and {100, 101} <= {k for k, _ in want}


def test_empty(spark):
    for find in (leaks.leaked_items, leaks.near_items):
        assert run(spark, [], [(1, ITEM)], find) == {} and run(spark, [(1, ITEM)], [], find) == {} and run(spark, [(1, None)], [(1, None)], find) == {}


def test_words():
    assert words("It's a state-of-the-\n  art TEST_case.") == ["its", "a", "stateoftheart", "testcase"]
    assert words(None) == [] and words("...") == []
