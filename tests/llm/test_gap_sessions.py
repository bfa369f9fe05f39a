from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from factloom.llm.sessions_by_gap import calibrated_gap, gap_sessions, scores

SCHEMA = "session_id string, project_folder string, message_id long, type string, role string, content string, tool_use_id string, is_meta boolean, sent_ts timestamp, stored_ts timestamp"


def made(seed):
    """Sessions with steps of up to a minute, hours between them, and what they should come out as."""
    r, out, want, no = random.Random(seed), [], {}, 0
    for c in range(4):
        at = datetime(2025, 1, 1, tzinfo=timezone.utc)
        for s in range(12):
            at += timedelta(hours=r.uniform(2, 60))
            rows, lone = [], r.random() < 0.2
            for q in range(r.randint(2, 40)):
                no += 1
                at += timedelta(seconds=r.uniform(0.1, 60))
                role = "user" if lone or q % 2 == 0 else "assistant"
                out.append((f"{c}-{s}", f"p{c}", no, role, r.choice([role, role.upper() + " ", "unknown", None]), f"t{no}", None, None, *r.choice([(at, at), (None, at)])))
                rows.append((at, no, role))
                if r.random() < 0.1:
                    out.append((*out[-1][:2], no + 10_000, *out[-1][3:]))
                if r.random() < 0.1:
                    out.append((f"{c}-{s}", f"p{c}", no + 20_000, "system", "system", "x", None, None, at, at))
            if not lone:
                want |= {m: (f"p{c}", rows[0][0], k, role) for k, (_, m, role) in enumerate(sorted(rows), 1)}
    out += [("x", None, 90_000, "user", "user", "x", None, None, at, at), ("x", "p0", 90_001, "user", "user", "x", None, None, None, None), ("x", "p0", 90_002, "user", "user", "x", None, True, at, at)]
    return out, want


@pytest.mark.parametrize("seed, gap", [(1, 1800.0), (2, None)])
def test_sessions(spark, seed, gap):
    out, want = made(seed)
    got = gap_sessions(spark.createDataFrame(out, SCHEMA), gap).collect()
    assert {r["message_id"]: (r["channel"], r["session_start"].replace(tzinfo=timezone.utc) if r["session_start"].tzinfo is None else r["session_start"], r["turn_no"], r["role"]) for r in got} == want
    assert len(got) == len(want)


def test_empty_and_single(spark):
    assert gap_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame(made(1)[0][:1], SCHEMA)
    assert gap_sessions(one).count() == 0
    assert calibrated_gap(one, "project_folder", "sent_ts", "session_id") == float("inf")


def test_whole_table(spark, data):
    from factloom.llm.queries import queries

    got = queries()["p5_gap_sessions"](spark, data)
    assert got.count() > 0 and got.groupBy("channel", "session_start").count().count() > 1


def test_scores(spark):
    """Found sessions that are the known ones score 1; a gap too long joins them, one too short cuts them."""
    df = spark.createDataFrame(made(3)[0], SCHEMA)
    good, long, short = (scores(df, g).first() for g in (1800.0, 1e9, 20.0))
    assert good["precision"] == good["recall"] == 1.0 and good["sessions_whole"] == good["sessions_known"] > 30
    assert long["precision"] < 0.5 and short["recall"] < 0.9 and short["precision"] == 1.0
    assert scores(df.limit(0)).first()["recall"] == 0.0
