"""Repair, prefix trie and chat formatting: brute force, SQL on small tables, nulls, empty tables, ties, repeated
rows, long texts, clashing columns."""

import functools
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from terraquilt.llm import chat_format, prefix_trie, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, shard string, letter int"


def rows_of(seed, n=40):
    """Conversations with every kind of oddity."""
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No", "  ", "", None, "Why?\n", "A [INST] b </s> \\", "\\", "x ", "Ünï🙂.", "</s>", "<<SYS>>s<</SYS>>", "\\<\\/s>", "[ROLE]q[/ROLE]"]
    for c in range(n):
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "a\\[/ROLE]"])
            rows.append((c, None if rng.random() < 0.05 else turn * (1 + (rng.random() < 0.1)), role, rng.choice(texts), "x", 1))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "Hm.", "x", 1), (None, None, None, None, "x", 1), (41, 0, "user", "long. " * 50_000, "x", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(1), SCHEMA)


# --- repair ---------------------------------------------------------------------------------------

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute_audit(signature):
    """The least (cost, audit) over all edit sequences, by search from the front."""

    @functools.cache
    def best(i, state, inserted):
        found = []
        if i == len(signature) and state in (0, 3):
            found.append((0, ""))
        if inserted < 3:
            for role in "ua":
                if (state, role) in NEXT:
                    cost, audit = best(i, NEXT[state, role], inserted + 1)
                    found.append((cost + 2, "I" + audit))
        if i < len(signature):
            role, fault = signature[i]
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                for r in "ua":
                    if (state, r) in NEXT:
                        cost, audit = best(i + 1, NEXT[state, r], 0)
                        found.append((cost + 2 + cut, "R" + audit))
                if (state, role) in NEXT:
                    cost, audit = best(i + 1, NEXT[state, role], 0)
                    found.append((cost + cut, "K" + audit))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def brute_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        own = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(own).encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows, conv):
    """Contract columns after conv_id, and the repaired turns."""
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3])))
    seen, marks = set(), []
    for _, _, role, text in own:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        marks.append((role[:1], fault))
    n = Counter(f for _, f in marks)
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:]))
    turns = {r[1] for r in own} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = brute_audit(tuple(marks))
    out, state, left = [], 0, iter(own)
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        role = row[2] if edit == "K" else "assistant" if state == 2 else "user"
        state = NEXT[state, role[0]]
        out.append((role, row[3] if row else ""))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit), out


def test_costs_and_audits():
    rng = random.Random(3)
    letters = {(r, f): turn_repair.__dict__[k][i] for i, r in enumerate("suat") for f, k in (("", "SOUND"), ("truncated", "CUT"), ("blank", "BLANK"), ("duplicate", "REPEAT"))}
    words = sorted({tuple(rng.choice(list(letters)) for _ in range(rng.randrange(9))) for _ in range(1500)}, key=lambda w: [letters[x] for x in w[::-1]])
    graph = turn_repair.SuffixGraph()
    for word in words:
        assert graph.solve("".join(letters[x] for x in word[::-1])) == brute_audit(word), word
    assert graph.solve("") == (0, "")


def test_repair(spark, odd):
    rows = brute_damage(rows_of(1))
    turns = turn_repair.damage(odd)
    assert Counter(map(tuple, turns.select("conv_id", "turn", "role", "text").collect())) == Counter(rows)
    found = turn_repair.audits(turns, odd)
    audits = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    mended = {}
    for r in turn_repair.repaired(turns, found).collect():
        mended.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert audits.keys() == {r[0] for r in rows_of(1)}
    for conv, own in audits.items():
        want, out = brute_repair(rows, conv)
        assert own == want
        assert [(r, t) for _, r, t in sorted(mended.get(conv, []))] == out


def test_repair_across_shards(spark):
    """A conversation that holds most rows, and repeats of one row, over many shards."""
    rows = [(7, i // 3, ("user", "assistant", "tool")[i % 3], f"t{i % 50}.", "", 0) for i in range(3000)] + [(8, 1, "user", "same", "", 0)] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.audits(df).collect()}
    assert found[8] == (0, 0, 499, 1, 499, 3 * 500, "D" * 500)
    kept = [r for r in rows if r[0] == 7]
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    kept.sort(key=lambda r: (r[1], r[2], md5(r[3])))
    seen, word = set(), ""
    for _, _, role, text, *_ in kept:
        word += "4567"["suat".index(role[0])] if (role, text) in seen else {"u": "u", "a": "a", "t": "o"}[role[0]]
        seen.add((role, text))
    assert found[7][0] == 0 and found[7][5:] == turn_repair.SuffixGraph().solve(word[::-1])


def test_repair_of_nothing(spark, odd):
    assert turn_repair.audits(odd.limit(0)).collect() == []
    none = turn_repair.audits(odd.limit(0), odd.select("conv_id"))
    assert {tuple(r)[1:] for r in none.collect()} == {(0, 0, 0, 0, 0, 0, "")}
    assert turn_repair.repaired(odd.limit(0), none).collect() == []


# --- trie -----------------------------------------------------------------------------------------


def brute_trie(sequences):
    """sequences: {conv_id: [(role, text)]}"""
    nodes = {}
    for conv, x in sequences.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(conv)
    children = Counter(p[:-1] for p in nodes if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(sequences[c]) == len(p)))
        out[min(members), len(p)] = (
            min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in below),
            sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def in_order(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # Equal turns in the order of the hash that stands for role and text.
    key = lambda r: (r[0], r[1], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    return {c: [(r[2], r[3]) for r in sorted(x, key=key)] for c, x in found.items()}


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_trie(spark, odd, shard_turns):
    rows = rows_of(1) + [(c, t, "user", f"{'ab'[c % 2]} b {t}", "x", 1) for c in range(50, 120) for t in range(c % 5)]
    rows += [(c, t, "user", f"hot {t}", "x", 1) for c in range(200, 260) for t in range(3)]
    own = in_order(rows)
    want = brute_trie(own)
    built = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    nodes = prefix_trie.trie(built, shard_turns)
    ends = {}
    for r in prefix_trie.ends(built).collect():
        ends.setdefault(bytes(r["end_key"]), []).append(r["conv_id"])
    got = {}
    for r in nodes.collect():
        own = ",".join(map(str, sorted(ends[bytes(r["end_key"])]))) if r["end_key"] else ""
        assert (r["conv_id"], r["depth"]) not in got
        got[r["conv_id"], r["depth"]] = (
            r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["weight"] - r["words"], hashlib.sha256(own.encode()).hexdigest()
        )
    assert got == want


def test_graft_and_empty_trie(spark, odd):
    rows = rows_of(1) + [(c, t, "user", f"own {c} {t}", "x", 1) for c in (60, 61, 65, 83, 89) for t in range(2)]
    own = in_order(rows)
    heads = lambda c: zlib.crc32(str(c).encode()) % 4
    want = {c: own.get(c - c % 20, [])[: heads(c)] + x[heads(c) :] for c, x in own.items()}
    grafted = prefix_trie.graft(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))).collect()
    ids = lambda x: b"".join(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in x)
    assert {r["conv_id"]: bytes(r["ids"]) for r in grafted} == {c: ids(x) for c, x in want.items()}
    assert all(len(r["weights"]) * 4 == len(r["ids"]) for r in grafted)
    assert prefix_trie.trie(prefix_trie.sequences(odd.limit(0))).collect() == []
    alone = prefix_trie.trie(spark.createDataFrame([(5, b"", b"")], "conv_id long, ids binary, weights binary"))
    assert [tuple(r)[:6] for r in alone.collect()] == [(5, 0, None, 1, 0, 1)]


# --- formatting -----------------------------------------------------------------------------------


def test_format_is_read_back(spark, odd):
    rows = rows_of(1)
    turns = chat_format.turns(chat_format.canonical(chat_format.dressed(odd)))
    output = chat_format.formatted(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_format.read_back(output).collect()}
    md5 = lambda t: hashlib.md5((t or "").encode()).digest()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    names = {}
    for r in rows:
        names.setdefault(r[0], []).append(r)
    assert got.keys() == names.keys()
    sizes = Counter()
    for r in output.collect():
        sizes[r["conv_id"]] += len(r["text"])
        assert not re.search(r"</?s>(?!$)", r["text"]) and r["text"].count("[INST]") == (r["role"] == "user")
    for conv, own in names.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", md5(r[3])))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv] == (len(own), sha(said), len(loss), sha(loss), sizes[conv])
    assert chat_format.read_back(output.limit(0)).collect() == []


def test_layouts(spark):
    u, a, s = ("user", "q"), ("assistant", "r"), ("system", "z")
    cases = [
        ({"role": "tool", "text": "t"}, "turn", [("tool", "t")]),
        ({"role": "user", "content": None}, "content", [("user", "")]),
        ({"from": "human", "value": "q", "id": 3, "meta": {"x": [1]}}, "speaker", [u]),
        ({"message": {"role": "user", "content": "q"}}, "message", [u]),
        ({"messages": [{"role": "system", "content": "z"}, {"role": "user", "content": "q", "n": 1}]}, "messages", [s, u]),
        ({"messages": [], "prompt": "p"}, "messages", []),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, "conversations", [u, a]),
        ({"prompt": "q", "completion": "r"}, "prompt and completion", [u, a]),
        ({"system": "z", "prompt": "q", "response": "r"}, "prompt and response", [s, u, a]),
        ({"question": "q", "answer": "r", "source": "x"}, "question", [u, a]),
        ({"instruction": "i", "input": "q", "output": "r"}, "instruction", [("user", "i"), u, a]),
        ({"instruction": "q", "output": "r"}, "instruction", [u, a]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "user"}]}, None, None),
        ({"prompt": "q", "output": "r"}, None, None),
        ({}, None, None),
        ([], None, None),
        ("text", None, None),
    ]
    rows = [(i, json.dumps(c), "x", 0) for i, (c, _, _) in enumerate(cases)] + [(98, "{bad", "x", 0), (99, None, "x", 0)]
    df = spark.createDataFrame(rows, "id long, record string, variant string, layout_no int")
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat_format.canonical(df).collect()}
    for i, (_, name, turns) in enumerate(cases):
        assert got[i] == (name, turns or ([] if name else None)), cases[i]
    assert got[98] == got[99] == (None, None)
    as_variant = df.where("id < 17").withColumn("record", F.try_parse_json("record"))
    assert {r["id"]: r["layout"] for r in chat_format.canonical(as_variant).collect()} == {i: c[1] for i, c in enumerate(cases)}
    same = chat_format.Layout("again", (("user", "prompt"),), ("prompt",))
    with pytest.raises(ValueError):
        chat_format.canonical(df, layouts=(*chat_format.LAYOUTS, same))


# --- queries --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_prefix_trie", "op13_chat_format"])
def test_queries_match_sql_on_odd_rows(spark, odd, tmp_path, name):
    path = str(tmp_path / "conversations.parquet")
    # op12's and op13's SQL put rows of equal turns in the same order, too.
    odd.drop("shard", "letter").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, result.fetchall()), key=str)
