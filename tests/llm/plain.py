"""Straightforward versions of the operators for small inputs, and a fixture of odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["h", "n", "bucket", "w", "shard", "tile", "_words", "rep", "component", "_key", "slot", "k", "v", "p", "_home"]


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCUMENT)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("x") for c in CLASHING})


PASSAGE = " ".join(f"alpha{i} Beta{i}" for i in range(30))


def odd_rows():
    """Null, empty and blank texts, one very long text, near copies, repeated rows, ties and a null id."""
    other = " ".join(f"gamma{i}" for i in range(80))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one"), (6, "two words"), (7, PASSAGE), (8, PASSAGE),
        (9, "start " + PASSAGE + " end"), (10, PASSAGE.upper()), (11, other), (12, other.replace("gamma40", "delta")),
        (12, other.replace("gamma40", "delta")), (13, "é ß 日本語 🎉 " + "x " * 50), (14, "long " + "word tail " * 30_000),
        (15, "!!! ### 123"), (16, other + " " + PASSAGE), (17, None), (18, "\x00 a\u2003b c\u00a0d")]


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, size):
    w = words(text, True)
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def jaccard(rows, size, num, den):
    """doc_id -> (set size, component)."""
    sets = {d: shingles(t, size) for d, t in rows}
    held = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    pairs = []
    for d, s in sets.items():
        for e in {e for x in s for e in held[x] if e < d}:
            both = len(s & sets[e])
            if den * both >= num * (len(s) + len(sets[e]) - both):
                pairs.append((d, e))
    lead = roots(pairs, sets)
    return {d: (len(sets[d]), lead[d]) for d in sets}


def removed(rows, size):
    """doc_id -> (words, positions removed); rows with one text per doc_id."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out[d] = (w, gone)
    return out


def contaminated(rows, items, size=5, share=0.8):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for item, text in items:
        iw = split(text)
        k = min(len(iw), size)
        if not k:
            continue
        want = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)}
        for d, t in rows:
            w = split(t)
            if len(want & {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) >= share * len(want) - 1e-9:
                out.add((d, item))
    return out


def host_path(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOW), slash + path


def judged(pages):
    """page_id -> (host, path, rule, verdict) by the five rules and dictionary walks over the links."""
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    parsed, out, lead, names = [], {}, collections.Counter(), {}
    for page, url, html in pages:
        host, path = host_path(url)
        fit = [r for r in rules if ("." + host).endswith("." + r[1]) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        parsed.append((page, host, path, best))
        if host:
            lead[host] += 0 if best is None else 1 if best[0] == "allow" else -1
        text = (html or "").translate(LOW)
        quoted = re.findall("""["'] *(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>]+)""", text)
        bare = re.findall("""[ \n=(:>]//([^/?#\\s"'<>]+)""", " " + text)
        names[page] = {*quoted, *bare, *re.findall(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+", text)}
    edges = collections.Counter((host, n) for page, host, _, _ in parsed for n in names[page] if host and n in lead and n != host)
    total = sum(map(abs, lead.values())) or 1
    rank = {}
    for kind, sign in (("trust", 1), ("distrust", -1)):
        ahead = collections.defaultdict(list)
        for (a, b), n in edges.items():
            a, b = (a, b) if sign > 0 else (b, a)
            ahead[a].append((b, n))
        going = {h: abs(v) / total for h, v in lead.items() if v * sign > 0}
        rank[kind] = collections.Counter()
        for _ in range(200):
            after = collections.Counter()
            for h, x in going.items():
                rank[kind][h] += 0.15 * x
                for b, n in ahead[h]:
                    after[b] += 0.85 * x * n / sum(k for _, k in ahead[h])
            going = after
    for page, host, path, best in parsed:
        method = "block" if rank["distrust"][host] > rank["trust"][host] + 1e-9 else "allow"
        out[page] = (host, path, best[1] + best[2] if best else None, best[0] if best else method)
    return out


def katz(rows, held_out):
    """doc_id -> (tokens, known, base, score), and the conditional distribution of each history summed."""
    docs = {d: [*words(t, True), "</s>"] for d, t in rows}
    c, pairs, before = collections.Counter(), collections.Counter(), collections.Counter()
    for d, w in docs.items():
        if not held_out(d):
            h = ["<s>", *w[:-1]]
            c.update(w), pairs.update(zip(h, w)), before.update(h)
    n, v = sum(c.values()), len(c)

    def good_turing(x):
        seen = collections.Counter(x.values())
        tail = 6 * seen[6] / seen[1] if seen[1] else 1.0
        d = {6: 1.0}
        for r in range(1, 6):
            ratio = (r + 1) * seen[r + 1] / (r * seen[r]) if seen[r] else 0.0
            d[r] = (ratio - tail) / (1 - tail) if tail < 1 else 0.0
            if not seen[r] or not 0 < d[r] < 1:
                d[r] = r / (r + 1)
        return d

    d1, d2 = good_turing(c), good_turing(pairs)
    freed = sum((1 - d1[k]) * k for k in c.values() if k <= 5)
    unknown = freed / n if freed > 0 else 1 / (n + 1)
    p1 = lambda w: d1[min(c[w], 6)] * c[w] / (n if freed > 0 else n + 1) if c[w] else unknown
    kept = collections.defaultdict(list)
    for (h, w), k in pairs.items():
        if k:
            kept[h].append((w, d2[min(k, 6)] * k))
    state = {}
    for h, total in before.items():
        mass = sum(m for _, m in kept[h])
        total += total - mass <= 1e-9 * total
        state[h] = (total, (1 - mass / total) / (1 - sum(p1(w) for w, _ in kept[h])))
    sums = {h: sum(m for _, m in kept[h]) / t + a * (1 - sum(p1(w) for w, _ in kept[h])) for h, (t, a) in state.items()}
    out = {}
    for d, ws in docs.items():
        score = 0.0
        for h, w in zip(["<s>", *ws[:-1]], ws):
            k = pairs[h, w]
            score += math.log10(d2[min(k, 6)] * k / state[h][0] if k else state.get(h, (0, 1.0))[1] * p1(w))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out[d] = (len(ws), sum(c[w] > 0 for w in ws), base, score)
    return out, sums, n


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
