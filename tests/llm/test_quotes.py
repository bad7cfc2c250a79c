import random
import re

from quire.llm import quotes

MARKS = re.compile(r"^(?: {0,3}>)+")
INTRODUCES = re.compile(r"(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\s*:\s*$", re.I)


def normal(x):
    return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())


def parse(text):
    runs = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        m = MARKS.match(line)
        level = m[0].count(">") if m else 0
        content = re.sub(r"^(?: {0,3}>)+ ?", "", line)
        if runs and runs[-1][0] == level:
            runs[-1][1].append(content)
        else:
            runs.append((level, [content]))
    own = []
    for k, (level, lines) in enumerate(runs):
        if not level:
            cut = k + 1 < len(runs) and INTRODUCES.search(lines[-1])
            own += lines[:-1] if cut else lines
    return runs, own


def units(lines):
    return {u for u in [*map(normal, lines), normal(" ".join(lines))] if u}


def brute(rows):
    said, out = {}, []
    for conv, turn, _, text in rows:
        runs, own = parse(text)
        every = units(own)
        for level, lines in runs:
            every |= units(lines) if not level else set()
        for p in re.split(r"\n[ \t]*\n", "\n".join(own)):
            every |= units(p.split("\n"))
        for u in every:
            said[conv, u] = min(turn, said.get((conv, u), turn))
    parent = {}
    for conv, turn, _, text in rows:
        votes, linked = {}, set()
        for k, (level, lines) in enumerate(r for r in parse(text)[0] if r[0]):
            for u in units(lines):
                if said.get((conv, u), turn) < turn:
                    o = said[conv, u]
                    votes[level, o] = votes.get((level, o), 0) + len(u)
                    linked.add(k)
        if votes:
            level, o = max(votes, key=lambda v: (-v[0], votes[v], v[1]))
            parent[conv, turn] = (o, len(linked))
    for conv, turn, role, text in rows:
        runs, own = parse(text)
        thread, depth = turn, 0
        while (conv, thread) in parent:
            thread, depth = parent[conv, thread][0], depth + 1
        quoted = sum(1 for level, _ in runs if level)
        to, n = parent.get((conv, turn), (None, 0))
        out.append((conv, turn, role, to, thread, depth, quoted, n, (text or "") if not quoted else "\n".join(own).strip()))
    return sorted(out)


def corpus(seed=0):
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(r.choice([1, 4, 40 if conv == 3 else 9])):
            lines = [" ".join(r.choice(["Été", "b", "c!", "d", "no"]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))]
            text = r.choice(["\n", "\r\n"]).join(lines)
            if said and r.random() < 0.6:
                old = r.choice(said).splitlines()
                part = old[r.randrange(len(old)) :] if r.random() < 0.5 else old
                quote = "\n".join(r.choice(["> ", ">", " >"]) + x for x in part)
                text = r.choice(["On Monday X wrote:\n", "", "hm\n"]) + quote + "\n" + text + ("\n> unknown words" if r.random() < 0.2 else "")
            said.append(text)
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
    return rows + [(50, 0, "user", None), (50, 1, "user", ""), (50, 2, None, ">"), (50, 3, "user", "> \n>> deep\n>>> deeper\nend")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted((tuple(x) for x in quotes.reply_threads(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda x: x[:2])
    want = sorted(brute(rows), key=lambda x: x[:2])
    assert got == want
    assert sum(w[3] is not None for w in want) > 15 and max(w[5] for w in want) >= 2


def test_sql_agrees():
    import duckdb
    import pyarrow as pa

    from quire.llm.oracles import QUOTATIONS

    rows = corpus(5)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[i] for r in rows] for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
    got = con.execute(QUOTATIONS)
    at = [[d[0] for d in got.description].index(c) for c in ("conv_id", "turn", "role", "reply_to", "thread", "depth", "n_quotes", "n_linked", "body")]
    assert sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=lambda x: x[:2]) == sorted(brute(rows), key=lambda x: x[:2])


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 1, "user", "> a"), (1, None, "user", "> a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 2, "user", "> A."), (1, 2, "user", "> A.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = quotes.reply_threads(frame.selectExpr("*", "1 as thread", "2 as body")).collect()
    assert len(got) == 6 and [(x.reply_to, x.thread, x.body) for x in got if x.turn == 2] == [(0, 0, "")] * 2
    assert all(x.reply_to is None for x in got if x.turn != 2)
    assert quotes.reply_threads(frame.limit(0)).count() == 0


def test_order(spark):
    got = quotes.reply_ordered(quotes.reply_threads(spark.createDataFrame(corpus(), SCHEMA))).collect()
    place = {(x.conv_id, x.turn): k for k, x in enumerate(got)}
    assert all(place[x.conv_id, x.reply_to] < place[x.conv_id, x.turn] for x in got if x.reply_to is not None)
