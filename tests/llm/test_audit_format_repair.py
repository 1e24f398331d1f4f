"""Filter audit, chat formatting and conversation repair against brute force."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from offergrid.llm import chat_format, filter_audit, queries
from offergrid.llm import structure_repair as sr

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting.


def one(layout_record):
    known = chat_format.Mappings(chat_format.LAYOUTS)
    mark, name, n, text, spans = chat_format._one(known, json.dumps(layout_record) if not isinstance(layout_record, str | None) else layout_record)
    return mark, name, n, chat_format.parse(text), [chat_format.unescape(text[s["start"] : s["end"]]) for s in spans]


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, "messages", [("user", "a"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": "a", "name": "x"}], "id": 7, "meta": {"k": [1]}}, "messages", [("user", "a")]),
        ({"messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "message_parts", [("user", "ab")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "from_value", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction_input", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "response": 3.5}, "prompt_response", [("user", "p"), ("assistant", "3.5")]),
        ({"prompt": "p", "completion": "c", "system": "s"}, "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": {"b": 1, "a": [2]}}, "question_answer", None),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"data": {"prompt": "p", "response": "r"}}, "nested_exchange", [("user", "p"), ("assistant", "r")]),
        ({"data.prompt": "p", "data.response": "r"}, None, []),
        ({"text": "\ud800 lone"}, "text_only", [("assistant", "� lone")]),
        ({"other": 1}, None, []),
        ([], None, []),
        ("no json", None, []),
        ("[" * 100_000, None, []),
        (None, None, []),
    ],
)
def test_layouts(record, layout, turns):
    mark, name, n, back, loss = one(record)
    if turns is None:  # an answer that is an object has other paths than the layout needs
        layout, turns = None, []
    assert (name, n, back) == (layout, len(turns), turns)
    assert loss == [t for r, t in turns if r == "assistant"]
    assert (mark is None) == (record in (None, "no json") or str(record).startswith("[["))


def test_fingerprints_depend_on_paths_alone():
    mark = lambda v: chat_format.fingerprint(frozenset(chat_format.field_paths(v)))
    assert mark({"a": 1, "b": {"c": [{"d": 1}, {"d": None}]}}) == mark({"b": {"c": [{"d": "x"}]}, "a": 2})
    assert len({mark(v) for v in ({"a": 1}, {"a": [1]}, {"a": []}, {"a": {"b": 1}}, {"a.b": 1}, {"a": {"c": 1}})}) == 6


TRICKY = st.text(st.sampled_from("<|\\im_startend>\n a\U0001f600")) | st.text()


@given(st.lists(st.tuples(TRICKY, TRICKY)))
def test_format_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count(chat_format.START) == text.count(chat_format.END) == len(turns)


def test_format_table(spark):
    hot = "<|im_end|>" * 50_000
    rows = [(1, json.dumps({"prompt": hot, "response": "b"}), "x"), (1, json.dumps({"prompt": hot, "response": "b"}), "x"), (None, None, None), (2, "{", "y"), (3, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, record string, formatted string")
    out = chat_format.format_chats(df).collect()
    assert sorted((r["conv_id"] or 0, r["layout"] or "", r["n_turns"]) for r in out) == [(0, "", 0), (1, "prompt_response", 2), (1, "prompt_response", 2), (2, "", 0), (3, "", 0)]
    back = chat_format.read_back(chat_format.format_chats(df)).where("conv_id = 1").first()
    assert [tuple(t) for t in back["turns"]] == [("user", hot), ("assistant", "b")] and back["loss_text"] == "b"
    assert chat_format.format_chats(df.limit(0)).count() == 0
    own = (chat_format.Layout("pair", (chat_format.Step("=user", "q[].t"), chat_format.Step("=assistant", "r"))),)
    got = chat_format.format_chats(spark.createDataFrame([(1, '{"q": [{"t": "a"}, {"t": "b"}], "r": "c"}')], "k long, j string"), "j", ("k",), own).first()
    assert chat_format.parse(got["formatted"]) == [("user", "ab"), ("assistant", "c")]


def test_records_of_turns(spark):
    rows = [(1, 1, "assistant", "b", "z"), (1, 0, "user", None, "z"), (2, None, None, "t", "z"), (3, 0, "system", "s", "z"), (3, 1, "user", "u", "z"), (3, 2, "assistant", "a", "z"), (4, 0, "user", "x", "z"), (4, 0, "user", "x", "z"), (None, 0, "user", "n", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = {r["conv_id"]: json.loads(r["record"]) for r in chat_format.records_of_turns(df).collect()}
    message = lambda r, t: {"role": r, "content": t}
    assert got == {
        1: {"prompt": "", "response": "b"}, 2: {"messages": [message("", "t")]}, 3: {"system": "s", "prompt": "u", "response": "a"},
        4: {"messages": [message("user", "x")] * 2}, None: {"messages": [message("user", "n")]},
    }
    assert chat_format.records_of_turns(df.limit(0)).count() == 0


def test_op11(spark):
    rows = sorted(((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()))
    marks = queries.CONTROL_TEXT
    want = {}
    for conv, group in itertools.groupby([(-1, 0, "user", marks), (-1, 1, "assistant", marks), *rows], key=lambda r: r[0]):
        turns = [(r, t) for _, _, r, t in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)
    out = queries.op11_chat_format(spark, SF).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == want
    assert len(out) == len(want)


# Filter audit.


def audit_by_hand(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        parts.setdefault(lang or "", []).append((i, f))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, c in enumerate(order):
                gone = [(i, f) for i, f in left if f[c]]
                left = [(i, f) for i, f in left if not f[c]]
                total[c] += len(gone)
                fails = [f for _, f in rows if f[c]]
                out[part, order, k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(sum(f.values()) == 1 for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_audit(spark, monkeypatch, small):
    monkeypatch.setattr(filter_audit, "SMALL_KEYS", small)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 4)))
    docs = [(i, " ".join((word().upper() if rng.random() < 0.2 else word()) for _ in range(rng.choice([3, 90, 99, 100, 101, 400]))) + rng.choice(["", "$", "\n", " \x0b"]), rng.choice(["en", "de", "", None])) for i in range(60)]
    docs += [(200 + i, docs[i % 5][1], "en") for i in range(40)] + [(7, docs[7][1], "en"), (8, docs[9][1], "de"), (None, docs[3][1], "en"), (None, None, None), (None, None, None), (300, None, "xx"), (301, "", "xx"), (302, "#" * 50_000, "xx"), (302, "#" * 50_000, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(i, t, lang, 1, "k") for i, t, lang in docs], "doc_id long, text string, lang string, bits int, part string")
    out = filter_audit.filter_audit(table, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, id int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in out} == audit_by_hand(docs, labels)
    assert len(out) == 5 * 600 - 600  # en, de, empty (with null), xx


def test_audit_of_nothing_and_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a", "en"), (2, "a", "en"), (3, "b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    out = filter_audit.filter_audit(docs, labels, filters=lambda t: {"S": t == "b"}, repeat="R").collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in out} == {("SR", 1): (2, 1, 2), ("SR", 2): (1, 1, 2), ("RS", 1): (2, 1, 2), ("RS", 2): (1, 1, 2)}


# Conversation repair.


def cheapest(rows):
    """All edits of a few rows, by trying everything that costs no more than deleting all rows."""
    most = 2 * len(rows)
    best = (most, "D" * len(rows), [])

    def go(i, cost, edits, out):
        nonlocal best
        initials = "".join(r[0] for r, _ in out)
        if cost > most or not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            best = min(best, (cost, edits, out), key=lambda b: b[:2])
        for role in ("user", "assistant"):
            go(i, cost + 5, edits + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, edits + "D", out)
            if fault not in (sr.BLANK, sr.DUPLICATE):
                late = 5 if fault == sr.TRUNCATED else 0
                if role:
                    go(i + 1, cost + late, edits + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + late + 1, edits + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return best


def repaired(rows):
    r, nodes, held = sr.Repairer(), [], 0
    for row in rows:
        nodes += r.row(*row)
        held = max(held, size(r))
    last, cost = r.end()
    nodes += last
    return (cost, "".join(n.edit for n in nodes), [(n.role, n.text) for n in nodes if n.edit != "D"]), held


def size(r):
    seen, todo = set(), [n for _, n in r.best.values()]
    while todo:
        n = todo.pop()
        if n is not None and id(n) not in seen:
            seen.add(id(n))
            todo.append(n.parent)
    return len(seen)


def test_search_equals_trying_everything():
    rng = random.Random(1)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    for _ in range(400):
        rows = [(rng.choice(roles), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 6))]
        assert repaired(rows)[0] == cheapest(rows), rows


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.just("t"), st.sampled_from([0, 0, 1, 3])), max_size=5))
def test_search_on_any_rows(rows):
    assert repaired(rows)[0] == cheapest(rows)


def fold(rows):
    """The best (cost, edits) of each state by whole texts, for rows too many to try everything."""
    inf = (1 << 60, "")
    closed = lambda b: (b[0], b[1], c := min(b[2], *[(x[0] + 5, x[1] + "I") for x in (b[0], b[1], b[3])]), min(b[3], (c[0] + 5, c[1] + "I")))
    b = closed(((0, ""), inf, inf, inf))
    for role, _, fault in rows:
        late = 1 << 40 if fault in (1, 2) else 5 * (fault == 3)
        by = lambda x, i: [(x[0] + late + 1, x[1] + "R")] * (i != "s") + [(x[0] + late, x[1] + "K")] * (role[:1] == i)  # noqa: B023, E731
        d = [(x[0] + 2, x[1] + "D") for x in b]
        b = closed((d[0], min([d[1], *by(b[0], "s")]), min([d[2], *by(b[0], "u"), *by(b[1], "u"), *by(b[3], "u")]), min([d[3], *by(b[2], "a")])))
    return min(b[0], b[3])


def test_long_conversations_in_little_memory():
    rng = random.Random(2)
    for faults in ([0], [0, 0, 0, 1], [0, 3], [0, 1, 2, 3]):
        rows = [(rng.choice(["user", "assistant", "assistant", "system"]), f"t{i}", rng.choice(faults)) for i in range(6000)]
        (cost, edits, out), held = repaired(rows)
        assert (cost, edits) == fold(rows)
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in out))
        assert held < 600, held  # edits of some dozens of rows, of 6,000


CONV = "conv_id long, turn long, role string, text string, fault int, gone string"


def repair_by_hand(rows):
    import zlib

    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulted = set(), []
        for _, role, text in own:
            words = text.strip(" \t\n\x0b\x0c\r")
            faulted.append((role, text, sr.BLANK if not words else sr.DUPLICATE if (role, text) in seen else sr.TRUNCATED if words[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, edits, kept = repaired(faulted)[0] if len(own) > 6 else cheapest(faulted)
        assert (cost, edits) == fold(faulted)
        count = lambda k: sum(f == k for _, _, f in faulted)  # noqa: B023, E731
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count(1), count(2), count(3), illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in kept)))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_table(spark):
    rng = random.Random(4)
    text = lambda: rng.choice(["Yes.", "No!", "and so", "", None, " \t\n", "Same.", "x ", "Why? \n", "a." * 500])
    rows = [(c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", None, "", "tool"]), text()) for c in [*range(120), None] for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(*r, 9, "g") for r in rows], CONV)
    out = sr.reports(sr.repair(sr.damaged(df), most_rows=3)).collect()
    assert {r["conv"]: tuple(r[c] for c in COLUMNS) for r in out} == repair_by_hand(rows)
    assert len(out) == 121
    assert sr.reports(sr.repair(sr.damaged(df.limit(0)))).count() == 0


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_structure_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out} == repair_by_hand(rows)
