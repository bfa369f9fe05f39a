"""Literal versions of the definitions, for small tables held as pandas frames."""

from __future__ import annotations

import json
from collections import defaultdict

import pandas as pd
import regex

WORDS = regex.compile(r"[\p{L}\p{N}]+")


def seq(text):
    return [] if text is None or text != text else [w.lower() for w in WORDS.findall(text)]


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def p1(memory: pd.DataFrame) -> set:
    out, by_ns = set(), defaultdict(list)
    for i, ns, c in memory[memory.superseded_at.isna()][["id", "namespace", "content"]].itertuples(index=False):
        s = seq(c)
        by_ns[ns].append((i, s, set(s)))
    for rows in by_ns.values():
        for k, (i, s, x) in enumerate(rows):
            for j, t, y in rows[:k]:
                if s != t and min(len(x), len(y)) >= 0.69 * max(len(x), len(y)) and similarity(x, y) >= 0.7:
                    out.add((min(i, j), max(i, j)))
    return out


def p2(memory: pd.DataFrame) -> set:
    live = memory[memory.superseded_at.isna()]
    out = set()
    for ns, g in live.groupby("namespace"):
        rows = [(-(c if c == c and 0 <= c <= 1 else -1), -(t.value if not pd.isna(t) else -(1 << 62)), i) for i, c, t in g[["id", "confidence", "last_retrieved"]].itertuples(index=False)]
        out |= {(ns, k, r[2]) for k, r in enumerate(sorted(rows)[:5], 1)}
    return out


def p3(memory: pd.DataFrame) -> set:
    groups = defaultdict(list)
    for i, ns, c, tags in memory[memory.superseded_at.isna()][["id", "namespace", "content", "tags"]].itertuples(index=False):
        obj = None
        try:
            obj = json.loads(c)
        except (TypeError, ValueError):
            pass
        if isinstance(obj, dict):
            body = ("obj", frozenset((tuple(seq(k)), tuple(seq(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))) for k, v in obj.items()))
        else:
            body = ("text", tuple(seq(c)))
        tag = frozenset(t.strip().lower() for t in (tags or "").split(",") if t.strip())
        groups[ns, body, tag].append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def p4(memory: pd.DataFrame, batch: pd.DataFrame) -> set:
    accepted, refs, cases = defaultdict(list), set(), set()

    def ref(r, t):
        return None if r is None or not r.strip() or pd.isna(t) else (r, t)

    for ns, c, r, t in memory[memory.superseded_at.isna()][["namespace", "content", "source_ref", "ingestion_ts"]].itertuples(index=False):
        accepted[ns].append(set(seq(c)))
        refs.add(ref(r, t))
    refs.discard(None)
    for row, ns, c, r, t in batch.sort_values(["batch_no", "line_no"])[["row_id", "namespace", "content", "source_ref", "ingestion_ts"]].itertuples(index=False):
        x = set(seq(c))
        if ref(r, t) in refs or any(min(len(x), len(y)) >= 0.69 * max(len(x), len(y)) and similarity(x, y) >= 0.7 for y in accepted[ns]):
            cases.add(row)
            continue
        accepted[ns].append(x)
        refs.add(ref(r, t))
        refs.discard(None)
    return cases


def p5(message: pd.DataFrame) -> set:
    best = {}
    for m in message.itertuples(index=False):
        if m.session_id is None:
            continue
        key = (m.session_id, None if pd.isna(m.seq) else int(m.seq))
        rank = (pd.Timestamp.min.tz_localize("UTC") if pd.isna(m.stored_ts) else m.stored_ts, m.message_id)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, m)
    sessions = defaultdict(list)
    for (s, q), (_, m) in best.items():
        sessions[s].append((q, m))
    out = set()
    for s, rows in sessions.items():
        if any(q is None for q, _ in rows) or sorted(q for q, _ in rows) != list(range(1, len(rows) + 1)):
            continue
        rows.sort(key=lambda x: x[0])
        roles = [(m.role or "").strip().lower() for _, m in rows]
        if any(r not in ("user", "assistant", "system") for r in roles):
            continue
        kept = []
        for (q, m), role in zip(rows, roles):
            tool = None if m.tool_use_id is None or m.tool_use_id != m.tool_use_id else m.tool_use_id
            if role == "system" or m.is_meta is True or m.is_meta == 1:
                continue
            if tool is None:
                text = m.content
                try:
                    arr = json.loads(m.content)
                    if isinstance(arr, list):
                        text = "".join(b.get("text") or "" for b in arr if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str))
                except (TypeError, ValueError):
                    pass
                if text is None or text != text or not text.strip():
                    continue
            kept.append((q, m, role, tool))
        tools = defaultdict(list)
        for q, m, role, tool in kept:
            if tool is not None:
                tools[tool].append((q, role))
        if any([r for _, r in sorted(t)] != ["assistant", "user"] for t in tools.values()):
            continue
        said = [role for _, _, role, tool in kept if tool is None]
        if not said or said[0] != "user" or said[-1] != "assistant" or any(a == b == "user" for a, b in zip(said, said[1:])):
            continue
        out |= {(s, k, m.message_id) for k, (_, m, _, _) in enumerate(kept, 1)}
    return out


def p8(documents: pd.DataFrame, length: int = 120) -> set:
    seen, out = {}, set()
    for i, t in documents[["doc_id", "text"]].itertuples(index=False):
        for s in range(len(t or "") - length + 1):
            seen.setdefault(t[s : s + length], set()).add(i)
    for i, t in documents[["doc_id", "text"]].itertuples(index=False):
        cur = None
        for s in range(len(t or "") - length + 1):
            if len(seen[t[s : s + length]]) > 1:
                if cur and s <= cur[1]:
                    cur[1] = s + length
                else:
                    if cur:
                        out.add((i, *cur))
                    cur = [s, s + length]
        if cur:
            out.add((i, *cur))
    return out
