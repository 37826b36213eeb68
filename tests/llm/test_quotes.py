import pytest
from pyspark.sql import functions as F

from quillvec.llm import quotes

TALK = [
    (1, 0, "user", "How do I sort a list?\nIt has names."),
    (1, 1, "assistant", "> How do I sort a list?\n\nUse sorted.\n\nIt gives a new list."),
    (1, 2, "user", "On Monday, bot wrote:\n> Use sorted.\n> > How do I sort a list?\nThanks, and in place?"),
    (1, 3, "assistant", "> It  GIVES a new list.\nThen use sort."),
    (1, 4, "user", "Fine."),
    (2, 0, "user", "> Use sorted.\nI read this elsewhere."),
    (2, 1, "assistant", "> words that nobody wrote\nHm."),
    (3, 5, "user", None),
    (3, 7, "user", ""),
    (None, 0, "user", "lost"),
    (4, 0, "user", "a"), (4, 0, "user", "b"),
]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(*t, 1) for t in TALK], "conv_id long, turn long, role string, text string, depth int")
    return {(r.conv_id, r.turn): r for r in quotes.thread(df).collect()}


def test_replies(made):
    to = {k: (r.reply_conv, r.reply_turn) for k, r in made.items()}
    assert to == {
        (1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 1), (1, 4): (1, 3), (2, 0): (1, 1), (2, 1): (2, 0),
        (3, 5): (None, None), (3, 7): (None, None), (4, 0): (None, None),
    }
    assert {k: r.depth for k, r in made.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 3, (2, 0): 2, (2, 1): 3, (3, 5): 0, (3, 7): 0, (4, 0): 0}
    assert {(r.root_conv, r.root_turn) for k, r in made.items() if k[0] < 3} == {(1, 0)}


def test_texts_without_quotes(made):
    assert made[1, 0].text == TALK[0][3]
    assert made[1, 1].text == "Use sorted.\n\nIt gives a new list."
    assert made[1, 2].text == "Thanks, and in place?"
    assert made[2, 1].text == "Hm." and made[3, 5].text == "" and made[4, 0].text == "a"


def test_counts(made):
    assert (made[1, 2].n_quoted, made[1, 2].n_linked) == (2, 2)
    assert (made[2, 1].n_quoted, made[2, 1].n_linked) == (1, 0)


def test_levels(spark):
    row = spark.createDataFrame([("a\n> b\n>> c\n> > d\r\n   > e\n    > code\n>",)], "t string").select(quotes.lines(F.col("t")).alias("x")).first()
    assert [(x.level, x.body) for x in row.x] == [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (1, "e"), (0, "    > code"), (1, "")]


def test_order_is_by_reply(spark):
    df = spark.createDataFrame([t for t in TALK if t[0] == 1], "conv_id long, turn long, role string, text string").repartition(3)
    assert [r.turn for r in quotes.thread(df).collect()] == [0, 1, 2, 3, 4]


def test_long_conversation_and_common_words(spark):
    """Many turns quote the one before; the same words stand in all. Roots are found by doubling, owners by running maxima."""
    rows = [(1, i, "user", f"> same\n> line {i - 1}\nsame\nline {i}") for i in range(300)]
    got = {r.turn: r for r in quotes.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[i].reply_turn == i - 1 and got[i].depth == i and got[i].root_turn == 0 and got[i].text == f"same\nline {i}" for i in range(1, 300))


def test_empty(spark):
    assert quotes.thread(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def plain_thread(rows):
    """Replies, roots and depths by the rules, one message after the other."""
    import re

    messages = dict(sorted(((c, t), x) for c, t, x in rows))
    parts = {}
    for at, text in messages.items():
        found, run, before = [], [], None
        for line in [*text.split("\n"), ""]:
            mark = re.match(r"[ \t]{0,3}(?:>[ \t]?)+", line)
            level, words = (mark.group().count(">"), line[mark.end() :]) if mark else (0, line)
            words = " ".join(words.split()).lower()
            if run and (level != before or not words):
                found.append((before, " ".join(run), len(run)))
                run = []
            if words:
                run.append(words)
                found.append((level, words, 1))
            before = level
        parts[at] = set(found)
    out = {}
    for (c, t), found in parts.items():
        votes, quoted, linked = {}, set(), set()
        for level, words, _ in sorted(p for p in found if p[0] > 0):
            quoted.add(words)
            near = [u for (d, u), ps in parts.items() if d == c and u < t and any(p[:2] == (0, words) for p in ps)]
            first = [at for at, ps in parts.items() if any(p[:2] == (0, words) for p in ps)]
            to = (c, max(near)) if near else first[0] if first and first[0][0] < c else None
            if to:
                linked.add(words)
                if level == 1:
                    votes[to] = votes.get(to, 0) + len(words)
        to = max(votes, key=lambda x: (votes[x], x[1], x[0])) if votes else (c, t - 1) if (c, t - 1) in messages else None
        out[c, t] = (to, len(quoted), len(linked))
    made = {}
    for at, (to, n, m) in out.items():
        root, depth = at, 0
        while out[root][0]:
            root, depth = out[root][0], depth + 1
        made[at] = (to, root, depth, n, m)
    return made


def test_against_the_rules_one_by_one(spark):
    import random

    random.seed(23)
    stock = [f"{random.choice('the a my our'.split())} {a} {b} {i}" for i, (a, b) in enumerate([(random.choice("cat dog house tree".split()), random.choice("runs sleeps burns grows".split())) for _ in range(60)])]
    rows, said = [], []
    for c in range(1, 7):
        for t in range(12):
            own = random.sample(stock, random.randint(1, 4))
            lines = []
            if said and random.random() < 0.6:
                _, _, quoted = random.choice(said[-30:])
                a = random.randrange(len(quoted))
                lines += [random.choice(["> ", ">", ">> ", " > > "]) + q for q in quoted[a : a + random.randint(1, 3)]] + [random.choice(["", "> not said before"])]
            lines += own
            rows.append((c, t, "\n".join(lines)))
            said.append((c, t, own))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): ((r.reply_conv, r.reply_turn) if r.reply_turn is not None else None, (r.root_conv, r.root_turn), r.depth, r.n_quoted, r.n_linked) for r in quotes.thread(df).collect()}
    want = plain_thread(rows)
    assert sum(v[4] > 0 for v in want.values()) > 15 and got == want
