"""Cleaning and preference pairs against plain versions."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from evergrain.functions import text as T
from evergrain.operators import factory

SMALL = "/root/testdata/sf0.001"
TURNS = "session_id string, turn_idx long, role string, kind string, text string, ts string, tool_error boolean, n_tool_calls long, authored_by string, sender_verified boolean"


def plain(pattern):
    pattern = re.sub(r"\(\?([a-z]*)U([a-z]*)\)", lambda m: f"(?{m[1]}{m[2]})" if m[1] + m[2] else "", pattern)
    return re.compile(pattern.replace(r"\z", r"\Z"))


def put(text):
    return re.sub(r"\$(\d)", r"\\\1", text)


def redacted(text):
    for pattern, new in T.REDACTIONS:
        text = plain(pattern).sub(put(new), text)
    return text


def sanitized(text):
    text = plain(T.REPLY_PREFIX).sub("", text or "")
    text = redacted(plain(T.UNTRUSTED_BLOCK).sub("", text))
    for pattern, new in ((T.EMAIL, "[REDACTED_EMAIL]"), (T.PHONE, "[REDACTED_PHONE]"), (T.LABELLED_ID, "$1$2[REDACTED_ID]"), (T.ACCOUNT_VALUE, "$1$2[REDACTED_ID]")):
        text = plain(pattern).sub(put(new), text)
    return text.strip()


def texts():
    found = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/documents.parquet' union all select text from '{SMALL}/conversations.parquet'").fetchall()]
    return found + [
        None, "", "  ", "[[reply_to_current]] [[reply_to_current]] hello", "mail a.b@example.com, x@y.org; phone 555-123-4567 or +1 (555) 123-4567", "chat_id: 12345678 and account number = AB-99887766", "my_api_key: hunter2hunter",
        "Sender (untrusted metadata):\n```json\n{\"a\": 1}\n```\nreal text", "token=abc secret: 'x y' password = \"p q\"", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "Bearer abcdefghijklmnopqrstuvwxyz", "broker account AB12345 and brokerage account 99-88-77",
    ]


def test_cleaning_by_plain_expressions(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k long, t string").select("k", T.redact_secrets(F.col("t")).alias("r"), T.sanitize(F.col("t")).alias("s"))
    got = {r["k"]: (r["r"], r["s"]) for r in df.collect()}
    assert got == {k: (None if t is None else redacted(t), sanitized(t)) for k, t in rows}
    assert sum("[REDACTED" in s for _, s in got.values()) > 8


def pairs_of(t, back=4):
    """The pairs of one session by looking at every turn each time."""
    people = [k for k, x in enumerate(t) if x[0] == "user"]
    answers = [k for k, x in enumerate(t) if x[0] == "assistant" and x[1]]

    def accepted(k):
        while True:
            follow = min((u for u in people if u > k), default=None)
            inside = [a for a in answers if a > k and (follow is None or a < follow)]
            if not inside:
                return None
            if follow is None:
                return inside[-1]
            if not t[follow][2]:
                return inside[-1] if t[follow][3] else None
            k = follow

    out, seen = [], set()
    tries = []
    for a in answers:
        ask, fix = max((u for u in people if u < a), default=None), min((u for u in people if u > a), default=None)
        if ask is not None and fix is not None and not t[ask][2] and t[fix][2]:
            tries.append(("strict", ask, a, fix, accepted(fix)))
    for fix in people:
        a = max((x for x in answers if fix - back <= x < fix), default=None)
        ask = None if a is None else max((u for u in people if u < a), default=None)
        if t[fix][2] and ask is not None and not t[ask][2]:
            end = accepted(fix)
            tries.append(("relaxed", ask, a, fix, fix if end is None and fix == people[-1] else end))
    for gate, ask, a, fix, end in tries:
        if end is not None and (t[a][1], t[end][1]) not in seen:
            seen.add((t[a][1], t[end][1]))
            out.append((gate, ask, a, fix, end))
    return out


def test_preference_pairs_by_brute_force(spark):
    rnd = random.Random(12)
    rows, want = [], {}
    for s in range(120):
        turns = []
        for k in range(rnd.randrange(2, 25)):
            role = rnd.choice(["user", "assistant", "assistant", "tool"])
            said = rnd.choice(["that's wrong, not what i asked {}", "thanks, perfect {}", "please do {}"]) if role == "user" else rnd.choice(["answer {}", "answer {}", ""])
            text = said.format(rnd.randrange(6) if role == "assistant" else k)
            turns.append((role, text, text.startswith("that's wrong"), text.startswith("thanks")))
            rows.append((f"s{s}", k, role, "bare" if role == "user" else "", text, None, False, 0, None, False))
        want[f"s{s}"] = pairs_of(turns)
    got = {s: [] for s in want}
    for r in factory.preference_pairs(spark.createDataFrame(rows, TURNS)).collect():
        got[r["session_id"]].append((r["gate"], r["request_idx"], r["rejected_idx"], r["correction_idx"], r["chosen_idx"]))
    assert {s: sorted(x) for s, x in got.items()} == {s: sorted(x) for s, x in want.items()}
    assert sum(map(len, want.values())) > 15
