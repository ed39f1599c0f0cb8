"""Plain versions of the operators, and tables with every odd case."""

import re
from collections import Counter, defaultdict

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, kept string, n long, rep long, size string, key int, bucket string, member long, h string, v string, __none int, found string, places string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    long = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(20000))
    base = " ".join(f"near{i}" for i in range(120))
    passage = " ".join(f"pass{i}" for i in range(60))
    other = lambda k, n: " ".join(f"o{k}y{i}" for i in range(n))
    return [
        None, "", " \n\t ", "a", "a b c d", "A  b\nC d", "same text of some words here", "same text of some words here", "same text of some words here",
        base, base + " tail", base.upper(), base.replace("near60", "x"), long, long + " end", "x" * 30000, f"{other(1, 30)} {passage} {other(2, 30)}", f"{other(3, 9)} {passage}",
        "Mail a.b@c.de, 1.2.3.4 or +1 (017) 555-7713; 4111 1111 1111 1111 <|endoftext|> ▁ é日本", "### $$$ " * 40, ("line of words\n" * 30), "Released under the MIT License.", None,
    ]


def odd_rows():
    rows = [(i, t, "en", [None, "a", "b", "b", "c"][i % 5], None) for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[9], (None, "same text of some words here", None, None, None), (None, None, None, None, None)]
    return [r + ("d", 1, "k", 5, 6, "s", 7, "b", 8, "h", "v", 9, "f", "p") for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids_sets):
    """Least id of each one's component; ids_sets: list of (id, set)."""
    nodes = {}
    for i, s in ids_sets:
        nodes.setdefault(i, []).append(s)
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(nodes)
    for a in keys:
        for b in keys:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in nodes[a] for t in nodes[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in nodes}


def quality(text):
    text = text or ""
    w = words(text)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    text = text or ""
    number = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) < 256],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(number(m)) <= 19 and luhn(number(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(number(m)) <= 15],
    }


def repeats(rows):
    """Spans and spans to drop of every text of 50 words or more that two places have, each text being one document."""

    def spans_of(places):
        out = []
        for a, b in sorted(places):
            if out and a <= out[-1][1]:
                out[-1][1] = max(b, out[-1][1])
            else:
                out.append([a, b])
        return out

    places = defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        w, spots = words(t), [m.span() for m in WORD.finditer(t)]
        for s in range(len(w) - 49):
            places[tuple(w[s : s + 50])][i].append((spots[s][0], spots[s + 49][1]))
    spans, drops = defaultdict(list), defaultdict(list)
    for by in places.values():
        if sum(map(len, by.values())) > 1:
            for i, p in by.items():
                spans[i] += p
                drops[i] += p if i > min(by) else [x for x in p if x[0] >= p[0][1]]
    text = lambda p: ",".join(f"{a}:{b}" for a, b in spans_of(p))
    return {i: (text(p), text(drops[i])) for i, p in spans.items()}
