"""Quotation linking against plain Python on random conversations, with hot, long and repeated ones."""

import time
from random import Random

import regex

from wayloom.llm import quotes

INTRO = regex.compile(r"^\s*(?:On\s.+\swrote|Le\s.+\sa écrit|Am\s.+\sschrieb.*|El\s.+\sescribió)\s*:\s*$")


def normal(text):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip()


def parse(text):
    lines = []
    for line in regex.split(r"\r?\n", text or ""):
        m = regex.match(r"[ \t]*((?:>[ \t]?)+)", line)
        lines.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    kept = [x for i, x in enumerate(lines) if not (INTRO.match(x[1]) and (lines[i + 1][0] if i + 1 < len(lines) else 0) > x[0])]
    passages, run = [], []
    for x in [*kept, (-1, "")]:
        if run and run[0][0] != x[0]:
            if run[0][0] > 0 and normal("\n".join(c for _, c in run)):
                passages.append((run[0][0], [c for _, c in run]))
            run = []
        run.append(x)
    own = regex.sub(r"\n(?:[ \t]*\n)+", "\n\n", "\n".join(c for d, c in kept if d == 0)).strip()
    return own, passages


def keys(whole, parts):
    return {normal(whole)} - {""} | {normal(p) for p in parts if len(normal(p)) >= quotes.MIN_LINE}


def brute(messages):
    out = {}
    for conv in {m[0] for m in messages}:
        rows = sorted((m[1], m[2], *parse(m[3])) for m in messages if m[0] == conv)
        said = {}
        for turn, _, own, _ in rows:
            for k in keys(own, regex.split(r"\n\s*\n", own) + own.split("\n")):
                said.setdefault(k, turn)
        parent = {}
        for turn, _, _, passages in rows:
            found = []
            for depth, lines in passages:
                by = {}
                for k in keys("\n".join(lines), lines):
                    if said.get(k, turn) < turn:
                        by[said[k]] = by.get(said[k], 0) + len(k)
                if by:
                    found.append((-depth, -max((n, -s) for s, n in by.items())[1]))
            if found:
                parent[turn] = max(found)[1]

        def root(t, parent=parent):
            while t in parent:
                t = parent[t]
            return t

        order = sorted((root(t), t, role, own) for t, role, own, _ in rows)
        place = {x[1]: i for i, x in enumerate(order)}
        for turn, role, own, passages in rows:
            out[conv, turn] = (role, parent.get(turn), root(turn), place[turn], len(passages), max((d for d, _ in passages), default=0), own)
    return out


def made(r, turns):
    words = "harbour market bridge school mill river stone council church morning ship baker winter letter window garden".split()
    said = []
    for t in range(turns):
        parts = []
        if said and r.random() < 0.7:
            quoted = r.choice(said)
            if r.random() < 0.4:
                parts.append("On Monday someone wrote:")
            lines = quoted.split("\n")
            lines = lines if r.random() < 0.6 else lines[: r.randint(1, len(lines))]
            parts += [">" * (1 if not x.startswith(">") else 1) + r.choice([" ", ""]) + (x.upper() if r.random() < 0.1 else x) for x in lines]
        parts += [" ".join(r.choices(words, k=r.randint(1, 8))) + r.choice([".", "?", ""]) for _ in range(r.randint(1, 3))]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), "")
        said.append("\n".join(parts))
        yield t, r.choice(["user", "assistant"]), said[-1]


def test_random_conversations(spark):
    r = Random(4)
    messages = [(c, *m) for c in range(40) for m in made(r, r.randint(1, 9))]
    got = quotes.link_quotes(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    want = brute(messages)
    assert len(got) == len(messages) and sum(w[1] is not None for w in want.values()) > 40
    for x in got:
        assert (x.role, x.parent_turn, x.root_turn, x.position, x.n_quotes, x.max_depth, x.text) == want[x.conv_id, x.turn], (x.conv_id, x.turn)


def test_one_long_conversation_and_very_long_texts(spark):
    start = time.time()
    long = " ".join(f"word{i}" for i in range(60_000))
    messages = [(1, 0, "user", long), (1, 1, "user", "> " + long + "\nyes"), (1, 2, "user", None)]
    messages += [(2, t, "user", (f"> reply number {t - 1} is here\n" if t else "") + f"reply number {t} is here") for t in range(600)]
    got = {(x.conv_id, x.turn): x for x in quotes.link_quotes(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].text == "yes" and got[1, 2].text == ""
    assert all(got[2, t].root_turn == 0 and got[2, t].position == t for t in range(600))
    assert time.time() - start < 120
