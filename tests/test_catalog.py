"""Registered queries against their DuckDB SQL at the smallest scale; the rest of the library without the corpus subpackage."""

import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evergrain.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    cols = sorted(df.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SMALL).toPandas()) == rows(con.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["sft_context", "sft_labels", "preference_pairs", "store_gate", "tripwire_flags", "leak_names"])
def test_runs(spark, name):
    assert len(catalog.QUERIES[name](spark, SMALL).columns) > 1


def test_correction_scores_of_every_turn(spark, tmp_path):
    cues = {
        r"\b(wrong|incorrect|not right|not correct)\b": 0.6, r"\b(that'?s not|not what i|didn'?t (ask|want)|that isn'?t)\b": 0.5, r"\b(should( not| n'?t)? be|shouldn'?t|supposed to be|misunderstood)\b": 0.4,
        r"\b(revert|undo|roll ?back|the mistake|you broke)\b": 0.4, r"\bactually\b": 0.3, r"\b(instead|rather)\b": 0.3, r"\b(don'?t|do not|stop|never|no longer)\b": 0.3, r"\b(fix|redo|try again|correct(ion)?)\b": 0.3,
        r"^\s*(no,|nope\b|no\b)": 0.3, r"\bit'?s (actually|not|really|supposed|meant to be)\b": 0.3, r"\byou (said|wrote|put|typed|had|called it|listed|meant)\b": 0.3, r"\bshould (say|read|use|return|point|have|go|include|match|show)\b": 0.4,
    }
    praise = r"\b(thanks|thank you|thx|perfect|great|nice|love it|ship it|beautiful|lgtm|awesome|exactly right|looks good|works|wonderful)\b"

    def plain(text):
        hits = [w for cue, w in cues.items() if re.search(cue, text or "", re.I)]
        return 0.0 if re.search(praise, text or "", re.I) and max(hits, default=0) < 0.5 else round(min(1.0, sum(hits)), 6)

    texts = [None, "", "that's wrong", "No, it's not what I asked, you wrote x, it should say y", "thanks, actually perfect", "great, but not right", "actually", "use b instead", "misunderstood", "please undo", "do not stop", "try again"]
    texts += [x for (x,) in duckdb.sql(f"select text from '{SMALL}/conversations.parquet'").fetchall()]
    pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    want = {k: plain(x) for k, x in enumerate(texts)}
    got = [(r["conv_id"], round(r["score"], 6)) for r in catalog.QUERIES["correction_scores_all"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and dict(got) == want and len(set(want.values())) > 4


def test_correction_scores_beyond_ascii_as_in_sql(spark, tmp_path):
    texts = ["not right\u00e9 at all", "\u00e9actually", "\u00a0no", "stop\u00e9", "\u017ftop it", "fi\u0130x redo", "in\u017ftead", "you broke\u0301", "\u00e9thanks, instead", "that\u0131s wrong\u4e2d", "\x0bno", "\u212aindly actually", None, "\u2003"]
    pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["correction_scores_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(catalog.ORACLES["correction_scores_all"]).fetchall())


def test_entry_without_corpus_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "evergrain").mkdir()
    for p in (root / "evergrain").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "evergrain" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); exec(open({str(tmp_path / '__spark_entry__.py')!r}).read().replace('from __future__ import annotations', '')); q = queries(); assert 'bm25_topk' in q and not any(k.startswith('op1') for k in q), list(q); assert set(oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_without_what_the_corpus_subpackage_imports():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
