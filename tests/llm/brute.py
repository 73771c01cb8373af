"""Plain Python versions of the queries' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[^\x20\x09-\x0D]+"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def op1(docs):
    pats = [("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    out = []
    for i, t in docs:
        sp = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(pats) for m in p.finditer(t or "") if ok(m))
        n = Counter(k for _, k, _ in sp)
        out.append((i, n[0], n[1], n[2], sha(",".join(f"{pats[k][0]}:{a}:{b}" for a, k, b in sp))))
    return out


def normal(z):
    return 1 / (1 + math.exp(max(-700.0, min(700.0, -1.5976 * z - 0.07056 * z**3))))


def battery(v):
    """Whether no test of the battery rejects randomness, and -10 log10 of the p value as text, of one token."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
    for pattern, k, places in (("[0-9a-f]+|[0-9A-F]+", 16, "0123456789abcdef"), ("[A-Z2-7]+=*", 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567="), ("[a-z]+|[A-Z]+", 26, "abcdefghijklmnopqrstuvwxyz"), ("[A-Za-z0-9]+", 62, letters), (".*", 64, letters)):
        if re.fullmatch(pattern, v):
            break
    n, body = len(v), v.lower() if k in (16, 26) else v
    x = [places.find(c) + 1 for c in body]
    ss = sum(c * c for c in Counter(body).values())
    df, chi = k - 1, k * ss / n - n
    z_chi = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [a > k / 2 for a in x]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    want = 2 * up * (n - up) / n + 1
    z_runs = (runs - want) / math.sqrt(max((want - 1) * (want - 2) / (n - 1), 0.01))
    mean = sum(x) / n
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / max(sum((a - mean) ** 2 for a in x), 1e-9) * math.sqrt(n)
    ok = min(normal(-z_chi), 2 * normal(-abs(z_runs)), 2 * normal(-abs(z_serial))) * 3 >= 0.003
    same = (ss - n) / (n * (n - 1))
    sd = math.sqrt(2 / (n * (n - 1)) * 0.066 * (1 - 0.066) + 4 * (n - 2) / (n * (n - 1)) * (0.0066 - 0.066**2))
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" for c in v if c.isalnum()]
    pairs, changes = max(len(kinds) - 1, 1), sum(a != b for a, b in zip(kinds, kinds[1:]))
    z_change = (changes - 0.5 - 0.05 * pairs) / math.sqrt(pairs * 0.05 * 0.95)
    p = min(1.0, 2 * min(normal((same - 0.066) / sd), normal(-z_change)))
    return ok, min(300, math.floor(-10 * math.log10(max(p, 1e-30))))


def op1_spans(docs):
    """All spans by doc_id: the base ones, and random tokens by Benjamini-Hochberg within classes of length."""
    base, tokens = {}, []
    pats = [("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for i, t in docs:
        base[i] = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(pats) for m in p.finditer(t or "") if ok(m)]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
            tokens.append((i, m.start(), m.end(), sum(len(m[0]) >= c for c in (32, 64, 128)), *battery(m[0])))
    least = {}
    for c in range(4):
        bins = Counter(b for *_, k, _, b in tokens if k == c)
        for b in sorted(bins):
            if 10 ** (-b / 10) * sum(bins.values()) / sum(n for x, n in bins.items() if x >= b) <= 0.01:
                least[c] = b
                break
    out = {i: [(a, k, b) for a, k, b in s] for i, s in base.items()}
    for i, a, b, c, ok, bin_ in tokens:
        if ok and c in least and bin_ >= least[c]:
            free = [p for p in range(a, b) if not any(x <= p < y for x, _, y in base[i])]
            for p in free:
                if p - 1 not in free:
                    q = p
                    while q + 1 in free:
                        q += 1
                    out[i].append((p, 3, q + 1))
    names = ["assign", "access", "hex", "random"]
    return {i: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(s)) for i, s in out.items()}


def redact(text, spans):
    """Groups of overlapping spans become one mark, of the first one's kind."""
    names, out, at, k = ["assign", "access", "hex", "random"], [], 0, 0
    spans = sorted(tuple(x) for x in spans)
    while k < len(spans):
        a, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:a], f"[SECRET:{names[kind]}]"]
        at = end
    return "".join(out) + text[at:]


def op2(turns):
    g = defaultdict(list)
    for c, t, r, x in turns:
        g[c].append((t, r or "", x or ""))
    out = []
    for c, ts in g.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out.append((c, len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss)))
    return out


def components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(t, n=4):
    w = re.findall(SPACE, (t or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def op5(docs, n=4, percent=85):
    sets = [shingles(t, n) for _, t in docs]
    groups = defaultdict(list)
    for k, s in enumerate(sets):
        if s:
            groups[s].append(k)
    keys = list(groups)
    by = defaultdict(list)
    links = []
    for k, s in enumerate(keys):
        seen = Counter(j for x in s for j in by[x])
        for j, common in seen.items():
            if 100 * common >= percent * (len(s) + len(keys[j]) - common):
                links.append((groups[s][0], groups[keys[j]][0]))
        for x in s:
            by[x].append(k)
    links += [(m[0], x) for m in groups.values() for x in m[1:]]
    roots = components(links, range(len(docs)))
    least = {}
    for k, (i, _) in enumerate(docs):
        least[roots[k]] = min(least.get(roots[k], i), i)
    return [(i, len(sets[k]), least[roots[k]]) for k, (i, _) in enumerate(docs)]


def op8(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws = lambda t: word.findall((t or "").translate(LOW))
    wins = defaultdict(set)
    for i, t in items:
        w = ws(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[k : k + window])].add(str(i))
    sizes = sorted({len(x) for x in wins})
    out = []
    for i, t in docs:
        w = ws(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= got
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def op9(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    return out
