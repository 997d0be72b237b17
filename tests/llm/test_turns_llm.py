import hashlib
import heapq
import random
import zlib

from ionweave.llm import turns
from ionweave.llm.turns import repair

WHITE = " \t\n\x0b\f\r"
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        one = lambda v: " " if v is None else str(v)
        out.setdefault(c, [])
        lot = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        r, x = one(r), one(x)
        x = "" if lot == 1 else "".join(ch for ch in x if ch not in ".!?") if lot == 2 else x
        out[c] += [(t, "user" if lot == 4 else r, x, k) for k in range(0 if lot == 0 else 2 if lot == 3 else 1)]
    order = lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), hashlib.md5(y[2].encode()).digest(), y[3])
    return {c: [y[:3] for y in sorted(v, key=order)] for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        body = x.strip(WHITE)
        out.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, fault):
    """The least (cost, audit) and its lines, by a search over whole audits in order of cost, then text: nothing is kept for states but what has been left."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (at, last, audit) in done:
            continue
        done.add((at, last, audit))

        def push(more, letter, to, line, here, base=(cost, audit, lines)):
            heapq.heappush(heap, (base[0] + more, base[1] + letter, here, to, base[2] + ((line,) if line is not None else ())))

        for x, role in (("u", "user"), ("a", "assistant")):
            if (last, x) in LEGAL and audit[-3:] != "III":
                push(2, "I", x, f"{role}:", at)
        if at < len(rows):
            _, r, text = rows[at]
            push(3, "D", last, None, at + 1)
            if fault[at] not in ("b", "d"):
                t = fault[at] == "t"
                if (last, r[:1]) in LEGAL:
                    push(t, "K", r[:1], f"{r}:{text}", at + 1)
                for x, role in (("u", "user"), ("a", "assistant")):
                    if (last, x) in LEGAL:
                        push(2 + t, "R", x, f"{role}:{text}", at + 1)
    raise AssertionError


def brute(rows):
    out = []
    for c, own in damage(rows).items():
        fault = faults(own)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        init = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(init, init[1:], strict=False))
        cost, audit, lines = cheapest(own, fault)
        out.append((c, gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, cost int, seg string")


def run(spark, rows, **how):
    return sorted((tuple(r) for r in repair(frame(spark, rows), **how).collect()), key=repr)


def talk(rnd, c, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "why", "A b c? ", "", " \t", None, "Fine.\x0b", "é ü.", "so ,"]
    return [(c, rnd.choice([k, k, k, k + 1, None]), rnd.choice(roles), rnd.choice(texts)) for k in range(n)]


def test_equals_a_search_over_audits(spark):
    rnd = random.Random(3)
    rows = [r for c in range(150) for r in talk(rnd, c if c else None, rnd.randint(1, 7))]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_sound_conversations_keep_all_that_damage_leaves(spark):
    rows = [(c, k, ["user", "assistant"][k % 2], f"Text {c} {k}.") for c in range(60) for k in range(4)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[7] == "KKKK" and r[6] == 0 for r in got)


def test_segments_join_to_the_same_repair(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [r for c in range(6) for r in talk(rnd, c, 7)] + [(9, k // 2, rnd.choice(["user", "assistant"]), rnd.choice(["A.", "B", f"C{k}."])) for k in range(9)]
    want = run(spark, rows)
    assert want == brute(rows)
    monkeypatch.setattr(turns, "STRETCH", 1)
    assert run(spark, rows, segment=3) == want
    assert run(spark, rows, segment=1) == want


def plain_costs(rows):
    """The least cost of one conversation by a table over rows and states, without audits."""
    own = damage(rows).popitem()[1]
    fault, best = faults(own), {"": 0}

    def grow(x):
        for _ in range(3):
            for q, c in list(x.items()):
                for r in "ua":
                    if (q, r) in LEGAL:
                        x[r] = min(x.get(r, 1 << 60), c + 2)
        return x

    for (_, r, _), f in zip(own, fault, strict=True):
        now = {}
        for q, c in grow(dict(best)).items():
            now[q] = min(now.get(q, 1 << 60), c + 3)
            if f not in ("b", "d"):
                for x, more in ((r[:1], 0), ("u", 2), ("a", 2)):
                    if (q, x) in LEGAL:
                        now[x] = min(now.get(x, 1 << 60), c + more + (f == "t"))
        best = now
    best = grow(dict(best))
    return min(best.get("", 1 << 60), best.get("a", 1 << 60))


def test_a_conversation_of_many_segments(spark):
    rnd = random.Random(1)
    rows = [(4, k, rnd.choice(["user", "assistant", "system"]), f"Text {k}" + rnd.choice([".", ""])) for k in range(3000)]
    got = run(spark, rows)
    assert len(got) == 1 and got[0][6] == plain_costs(rows)
    kept = damage(rows)[4]
    assert len(got[0][7].replace("I", "")) == len(kept)


def test_nothing_left_and_empty(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert run(spark, [(lost, 0, "user", "Hello.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", empty)]
    assert run(spark, []) == []


def test_names_and_very_long_texts(spark):
    df = spark.createDataFrame([(1, 2, "user", "Long " * 400_000 + ".")], "cost long, turn long, role string, text string")
    out = repair(df, "cost")
    assert out.columns == ["cost", "gaps", "blank", "duplicate", "truncated", "illegal", "cost_", "audit", "repaired_sha256"] and out.count() == 1


def test_batches_of_segments(spark):
    rnd = random.Random(11)
    rows = [r for c in range(30) for r in talk(rnd, c, 5)]
    assert run(spark, rows, batch_rows=5, segment=2) == run(spark, rows) == brute(rows)
