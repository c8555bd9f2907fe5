import datetime as dt
import random

import pytest

from loomspan.llm.threads import ThreadAutomaton, conversations, with_roles

SCHEMA = (
    "comment_id string, video_id string, parent_id string, published_at timestamp_ntz, total_reply_count bigint, last_seen timestamp_ntz, "
    "text_original string, author_channel_id string, thread_id string, symbol int"
)


def at(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)


def frame(spark, rows):
    return spark.createDataFrame([(c, v, p, at(t), n, at(s), x, a, "x", 7) for c, v, p, t, n, s, x, a in rows], SCHEMA)


def brute(rows):
    one = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[5])):
        one[r[0]] = r
    kids = {}
    for r in one.values():
        if r[2] and r[2].strip():
            kids.setdefault(r[2], []).append(r)
    found = set()
    for top in one.values():
        if top[2] and top[2].strip():
            continue
        members, ok, todo = [], True, [(top, None)]
        while todo:
            r, up = todo.pop()
            members.append(r)
            ok = ok and r[3] is not None and bool((r[6] or "").strip(" \n​")) and (up is None or r[1] is not None and r[1] == up[1])
            ok = ok and (up is None or up[3] is None or r[3] >= up[3])
            todo += [(k, r) for k in kids.get(r[0], [])]
        if ok and len(members) > 1 and len(members) - 1 >= (top[4] or 0):
            for n, r in enumerate(sorted(members, key=lambda r: (r[3], r[0]))):
                found.add((top[0], n, r[0]))
    return found


@pytest.mark.parametrize("held", [2, 10**6])
def test_against_brute_force(spark, held):
    rnd = random.Random(11)
    rows = []
    for n in range(160):
        up = None if n < 30 else f"c{rnd.randrange(max(0, n - 40), n):03d}"
        t = n * 25 + rnd.choice([0] * 30 + [-9000])
        video = f"v{n}" if up is None else None
        rows.append([f"c{n:03d}", video, up or rnd.choice([None, "", " "]), t, rnd.choice([None, 0, 0, 1, 3]), 1, rnd.choice(["hi"] * 40 + [" ​", None]), "a"])
    for r in rows[30:]:
        r[1] = next(q[1] for q in rows if q[0] == r[2])
    rows += [["x1", "v", "x2", 5, 0, 1, "t", "a"], ["x2", "v", "x1", 5, 0, 1, "t", "a"], ["x3", "v", "x3", 5, 0, 1, "t", "a"], ["x4", "v", "gone", 5, 0, 1, "t", "a"]]
    rows += [["c031", "other", "c001", None, 0, 0, "old", "a"], rows[40], [None, "v", None, 1, 1, 1, "t", "a"]]
    got = {tuple(r) for r in conversations(frame(spark, rows), held=held).select("thread_id", "msg_no", "comment_id").collect()}
    assert got == brute(rows) and len(got) > 10


def test_deep_chain_roles_and_empty(spark):
    rows = [["c00", "v", None, 0, 20, 1, "t", "s"]] + [[f"c{n:02d}", "v", f"c{n - 1:02d}", n, 0, 1, "x" * 50_000 if n == 3 else "t", a] for n, a in zip(range(1, 21), ["o", "s", None, "z"] * 5)]
    comments = frame(spark, rows)
    videos = spark.createDataFrame([("v", "old", at(1)), ("v", "o", at(2)), (None, "q", at(3))], "video_id string, channel_id string, last_updated timestamp_ntz")
    out = with_roles(conversations(comments), comments, videos).orderBy("msg_no").collect()
    assert [r.role for r in out] == ["starter"] + ["owner", "starter", "other", "other"] * 5
    assert conversations(frame(spark, [])).collect() == []
    assert conversations(frame(spark, rows[:1])).collect() == []


def test_one_hot_thread_within_one_instant(spark):
    """All messages of one thread at the same time, spread over tasks; the top's id is in the middle."""
    rows = [["m050", "v", None, 5, 90, 1, "t", "a"]] + [[f"m{n:03d}", "v", "m050", 5, 0, 1, "t", "a"] for n in range(120) if n != 50]
    got = [tuple(r) for r in conversations(frame(spark, rows).repartition(4), held=7).orderBy("msg_no").collect()]
    assert got == [("m050", n, f"m{n:03d}") for n in range(120)]
    rows[0][4] = 120
    assert conversations(frame(spark, rows), held=7).collect() == []


def test_automaton():
    a = ThreadAutomaton
    run = lambda symbols: [s := 0] and [s := a.STEPS[x][s] for x in symbols][-1]
    assert run([a.TOP]) == a.OPEN and run([a.TOP, a.ANSWER, a.ANSWER]) == a.ANSWERED and run([a.ANSWER, a.TOP]) == a.ANSWERED
    assert run([a.ANSWER]) == a.BEFORE
    assert all(run(x) == a.BROKEN for x in ([a.TOP, a.TOP], [a.TOP, a.EMPTY, a.ANSWER], [a.UNDATED, a.TOP], [a.TOP, a.ANSWER, a.STRAY], [a.ANSWER, a.TOP, a.EARLY]))
