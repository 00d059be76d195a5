"""Chat formatting, Merkle manifest and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evergrain.llm import chat, merkle, repair

pytest.importorskip("public_tokenizers")
TURNS = "conv_id long, turn long, role string, text string, start int, piece string, at string, turns string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, node string, leaf string, proof string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]", "[TURN]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "a", "t") for r in rows], TURNS).repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: ordered(v) for k, v in out.items()}


def odd_texts(rnd, n):
    bits = [*CONTROL, *CONTROL, "\\", "\\\\", "<", "[", "<\\", "[\\/INST]", "/s>", "INST]", "ö", "😀", " ", "\n", "ok", "$1"]
    return ["".join(rnd.choices(bits, k=rnd.randrange(6))) for _ in range(n)]


def chat_rows():
    rnd = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "[TEXT]", "a[/ROLE]<s>", "", None]
    rows = [(c, t, rnd.choice(roles), x) for c in range(40) for t, x in enumerate(odd_texts(rnd, rnd.randrange(1, 9)))]
    rows += [(None, 3, "user", "no id"), (None, None, "assistant", None), (50, 1, "user", "twice"), (50, 1, "user", "twice"), (50, None, "system", None), (51, 0, "assistant", "")]
    rows += [(60, t, ("user", "assistant")[t % 2], "x" * 2000 + "</s>") for t in range(1500)] + [(61, 0, "assistant", "long [INST] " * 100_000)]
    return rows


def test_chats_come_back(spark):
    rows = chat_rows()
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns_frame(spark, rows))).collect()}
    want = by_conversation(rows)
    assert set(got) == set(want)
    for key, turns in want.items():
        assert [tuple(t) for t in got[key]["turns"]] == [(r[2] or "", r[3] or "") for r in turns]
        assert got[key]["learned"] == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    assert chat.format_chats(turns_frame(spark, [])).count() == 0


def test_chat_blocks_spans_and_marks(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b <s>"), (1, 3, "assistant", "é"), (1, 4, "assistant", ""), (1, 5, "tool", "t")]
    r = chat.format_chats(turns_frame(spark, rows)).first()
    assert r["formatted"] == r"<s>[SYS]s[/SYS][INST]a[TURN]b <\s>[/INST]é[TURN]</s>[ROLE]tool[TEXT]t[/ROLE]"
    assert [(b["role"], b["texts"]) for b in r["blocks"]] == [("system", ["s"]), ("user", ["a", "b <s>"]), ("assistant", ["é", ""]), ("tool", ["t"])]
    raw = r["formatted"].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in r["loss_spans"]] == ["é", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "]", ">", "/", "s", "INST"]), max_size=12))
def test_escape_rule_is_reversible(bits):
    """The patterns themselves, by Python's re, which reads them alike."""
    text = "".join(bits)
    hidden = re.sub(chat._HEAD.replace("{0}", "*"), r"\1\\", text)
    assert not any(c in hidden for c in CONTROL)
    assert re.sub(chat._HEAD.replace("{0}", "+") + r"\\", r"\1", hidden) == text


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(r, text):
    return sha("".join(plain_field(v) for v in (r[0], r[3], r[2], r[4], text)))


def plain_tree(nodes):
    """Root, and for each node its pairs of siblings."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            first = at // 3 * 3
            run = nodes[first : first + 3]
            proofs[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        where = [at // 3 for at in where]
    return nodes[0], proofs


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r, r[1])), r) for r in groups[s])
        nodes = [k[2] for k, _ in leaves]
        subroot, proofs = plain_tree(nodes)
        subroots.append(subroot)
        found.append([(r, leaf, p) for (_, r), leaf, p in zip(leaves, nodes, proofs)])
    root, tops = plain_tree(subroots)
    out = []
    for rows_of, subroot, top in zip(found, subroots, tops):
        for r, leaf, proof in rows_of:
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = plain_leaf(r, r[1].replace("\n", "") if cut else r[1])
            for left, right in proof + top:
                node = sha(left + node + right)
            out.append((r[0], leaf, subroot, root, sha("".join(a + b for a, b in proof + top)), node, node == root))
    return sorted(map(str, out))


def doc_rows():
    rnd = random.Random(8)
    rows = [(d, rnd.choice(["a\nb", "ü", "", None, "x\n" * 300]), rnd.choice(["en", None]), rnd.choice(["s", "s", "s", None, "", "ß", "t"]), rnd.choice([3, None])) for d in range(200)]
    rows += [(None, "no id\n", None, "s", 1), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1), (None, None, None, None, None), (900, "long\n" * 200_000, "en", "alone", 9), (901, "q", "en", "+", 1)]
    return rows


@pytest.mark.parametrize("kept", [slice(None), slice(0, 1), slice(0, 3), slice(198, 206)])
def test_manifest(spark, kept):
    rows = doc_rows()[kept]
    frame = spark.createDataFrame([(*r, 1, "n", "l", "p") for r in rows], DOCS).repartition(3)
    got = merkle.verified(merkle.manifest(frame))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], DOCS))).count() == 0


def test_manifest_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    rows = doc_rows()
    got = merkle.verified(merkle.manifest(spark.createDataFrame([(*r, 1, "n", "l", "p") for r in rows], DOCS)))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(rows)


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


SPACES = " \t\n\x0b\x0c\r"
MOVES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_repair(rows):
    """Counts, cost, audit and repaired turns of a conversation's rows in order, by trying all edits from the end on."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = text.strip(SPACES)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    marks = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "o" for r in rows]

    @cache
    def best(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in ("", "a") else []
        added = next(k for k in MOVES[state] if k != "s")
        if inserted < 3:
            w, rest = best(i, added, inserted + 1)
            out.append((w + 2, "I" + rest))
        if i < len(rows):
            w, rest = best(i + 1, state, 0)
            out.append((w + 3, "D" + rest))
            extra = faults[i] == "truncated"
            if faults[i] not in ("blank", "duplicate"):
                w, rest = best(i + 1, added, 0)
                out.append((w + 2 + extra, "R" + rest))
                if marks[i] in MOVES[state]:
                    w, rest = best(i + 1, marks[i], 0)
                    out.append((w + extra, "K" + rest))
        return min(out) if out else (10**9, "")

    for i in range(len(rows), 0, -100):
        for s in MOVES:
            best(i, s, 0)
    cost, audit = best(0, "", 0)
    state, i, turns = "", 0, []
    for letter in audit:
        added = next(k for k in MOVES[state] if k != "s")
        name = {"u": "user", "a": "assistant"}[added]
        if letter == "I":
            turns.append(f"{name}:")
            state = added
            continue
        if letter == "R":
            turns.append(f"{name}:{rows[i][3]}")
            state = added
        elif letter == "K":
            turns.append(f"{rows[i][2]}:{rows[i][3]}")
            state = marks[i]
        i += 1
    assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in turns))
    known = {r[1] for r in rows if r[1] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), sha("\n".join(turns))


def conversation_rows():
    rnd = random.Random(9)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None]
    texts = ["fine.", "fine.", "Why?", "no end", "", " \n", None, "odd ending. ", "cut. ", "Ok!\r\n", "x. y", "öh."]
    rows = []
    for c in range(150):
        turns = list(range(rnd.randrange(1, 10)))
        rows += [(c, rnd.choice([t, t, t * 3, None]), rnd.choice(roles), f"{rnd.choice(texts)}" if rnd.random() < 0.5 else rnd.choice(texts)) for t in turns]
    rows += [(None, t, "user", "no id.") for t in range(3)] + [(800, 0, "user", "long. " * 100_000), (800, 1, "assistant", "yes.")]
    return rows


def test_repair(spark):
    rows = plain_damage(conversation_rows())
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in repair.damage(turns_frame(spark, conversation_rows())).collect())
    check_repair(spark, rows)
    empty, lines = repair.repair(turns_frame(spark, []))
    assert empty.count() == 0 and repair.digests(lines).count() == 0


def test_repair_of_a_conversation_in_many_pieces(spark):
    """One conversation holds most rows and lies in all ranges; its duplicates are far apart."""
    rnd = random.Random(10)
    rows = [(5, t, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"text {t}.", f"text {t}", f"text {t - t % 400}.", " "])) for t in range(1200)]
    rows += [(6, t, "user", "same.") for t in range(300)] + [(7, 0, "assistant", "end")]
    check_repair(spark, rows)


def check_repair(spark, rows):
    found, edited = repair.repair(turns_frame(spark, rows))
    hashes = {r["key"]: r["repaired_sha256"] for r in repair.digests(edited).collect()}
    got = {r["conv_id"]: r for r in found.collect()}
    groups = by_conversation([(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows])
    assert set(got) == set(groups)
    for key, group in groups.items():
        want, digest = plain_repair(group)
        r = got[key]
        assert tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == want, key
        assert hashes.get(None if key is None else str(key), sha("")) == digest, key


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "hi."), (1, 2, "user", "hi.")]
    got = repair.repaired_turns(turns_frame(spark, rows)).orderBy("at", "k").collect()
    assert "".join(r["role"][0] for r in got) in ("ua", "uaua")
    assert spark.createDataFrame(got).where(F.col("text") != "").count() >= 1
