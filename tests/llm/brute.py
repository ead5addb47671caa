"""Plain-Python versions of the corpus operators' contracts, for tests on small tables."""

import hashlib
import re
from collections import Counter


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def secrets_base(text):
    """Spans (start, rank, end) of the base scan."""
    text, out = text or "", []
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for rank, (p, group, least) in enumerate(((assign, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))):
        out += [(m.start(), rank, m.end()) for m in p.finditer(text) if len(m[group]) >= least]
    return sorted(out)


def secrets_report(doc_id, text):
    spans = secrets_base(text)
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[r]}:{a}:{b}" for a, r, b in spans)
    return (doc_id, *(sum(r == k for _, r, _ in spans) for k in range(3)), sha(joined))


def fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    """Smallest reachable node, for hashable nodes and a symmetric test."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(docs):
    """{doc_id: (fingerprint, component)} of (doc_id, text) rows."""
    prints = [(i, fingerprint(t)) for i, t in docs]
    part = components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, p in prints:
        first[part[p]] = min(first.get(part[p], i), i)
    return {i: (f"{p:016x}", first[part[p]]) for i, p in prints}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    lines = [x for x in text.split("\n") if word.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    hit = {j for i, w in enumerate(windows) if found[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def battery(token):
    """(encoding, p, p_word) of a token: the tests of randomness in plain Python."""
    import math

    from lemmaflow.llm import secrets

    core = token.rstrip("=")
    for name, letters, shape in secrets.ENCODINGS:
        t = core if name == "base64" else core.replace("-", "")
        if re.fullmatch(shape.strip("^$"), t):
            break
    if name == "base64":
        t = t.replace("-", "+").replace("_", "/")
    e, n, k = secrets.facts(letters), len(t), len(letters)
    v = [letters.index(x) for x in t]
    chi = sum((v.count(a) - n / k) ** 2 / (n / k) for a in range(k))
    z = [((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))]
    up = [x >= k / 2 for x in v]
    high, turns = sum(up), 1 + sum(a != b for a, b in zip(up, up[1:]))
    mean = 2 * (n - high) * high / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z.append((turns - mean) / math.sqrt(var) if var > 0 else 9.0)
    avg = sum(v) / n
    around = sum((x - avg) ** 2 for x in v)
    z.append((sum((a - avg) * (b - avg) for a, b in zip(v, v[1:])) / around + 1 / n) * math.sqrt(n) if around > 1e-6 else 9.0)
    alpha, small = sum(x.isalpha() for x in t), sum(x.islower() for x in t)
    of, part, share = (alpha, small, 0.5) if e["cases"] else (n, alpha, e["share"])
    z.append((part - of * share) / math.sqrt(of * share * (1 - share)) if of else 0.0)
    z.append(sum(e["scores"][x] for x in v) / e["sd"] / math.sqrt(alpha) if alpha else 0.0)
    z.append(2 * (math.sqrt(sum(t[i : i + 2].lower() in secrets.PAIRS for i in range(n - 1))) - math.sqrt((n - 1) * e["pair"])))
    tail = lambda x: max(math.erfc(x / math.sqrt(2)) / 2, 1e-40)
    p = [tail(z[0]), *(2 * tail(abs(x)) for x in z[1:4]), tail(z[4]), tail(z[5])]
    h = max(0.0, -sum(map(math.log, p)) * 2 / 3)
    words, kind = 0.0, 3
    for x in v:
        words += e["words"][x] + math.log(secrets.FOLLOWS[kind][e["kinds"][x]])
        kind = e["kinds"][x]
    return name, math.exp(-h) * (1 + h + h * h / 2 + h**3 / 6), math.exp(max(-90.0, min(0.0, n * math.log(k) + words)))
