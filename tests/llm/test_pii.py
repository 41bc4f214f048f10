import hashlib
import random
import re
from collections import Counter

from plumbline.llm.pii import find, redact
from plumbline.llm.queries import op5_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for n, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), n, k, m.end()))
    return sorted(out)


LIKE = {
    "email": r"[A-Za-z0-9._%+-]+(?:@|\[at\]|\(at\))[A-Za-z0-9.\[\]()-]+",
    "ip": r"[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}",
    "card": r"[0-9](?:[.\x20-]?[0-9]){11,18}",
    "phone": r"\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,4}",
}
GAP = r"[\x20\x09-\x0D]"
PUNCT = re.compile(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
FIFTH = r"""["']([A-Za-z0-9_+/=-]{32,}+)(?=["'])"""
LIKE_FIFTH = rf"""(?:(?<={GAP})|(?<={GAP}["']))(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{{16,}}+(?=["'\x20\x09-\x0D.,;:!?]|$)"""


def plain(text):
    return re.sub("[1-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def left_of(text, last, start):
    before = re.sub("[\"']$", "", plain(text[last:start]))
    words = [w for w in re.split(f"{GAP}+", before) if w]
    if not words or not re.search(f"{GAP}$", before):
        return ""
    return words[-1] if not PUNCT.fullmatch(words[-1]) else " ".join(words[-2:])


def brute(texts):
    """All spans of each different (id, text), by plain loops over the whole corpus."""
    secret = lambda h: re.search("[0-9]", h) and re.search("[A-Za-z]", h)
    rows, kinds = {}, [*PATTERNS, "secret"]
    for i, t in set(texts):
        t, found, own = t or "", {}, base(t)
        for n, k in enumerate(kinds):
            seeds = PATTERNS.get(k, FIFTH)
            like = LIKE_FIFTH if k == "secret" else rf"(?<={GAP})(?:{LIKE[k]})(?=[\x20\x09-\x0D.,;:!?]|$)"
            for score, p in ((1.0, seeds), (0.0, like)):
                last = 0
                for m in re.finditer(p, t):
                    g = 1 if k == "secret" and score else 0
                    s, e, h = m.start(g), m.end(g), m[g]
                    valid = (s, n, k, e) in own if k != "secret" else secret(h)
                    if valid or not score and k != "secret":
                        key = (n, s, e)
                        if key not in found or found[key][0] < score:
                            found[key] = (score, left_of(t, last, s), h)
                    last = e
        touching = lambda n, s, e: any(a < e and s < b for a, _, _, b in own)
        rows[i, t] = {x: v for x, v in found.items() if v[0] and x[0] < 4 or not touching(*x)}
    met, graph = Counter(), {}
    for _, t in texts:
        words = [w for w in re.split(f"{GAP}+", plain(t or "")) if w]
        met.update(words)
        met.update(f"{a} {b}" for a, b in zip(words, words[1:]) if PUNCT.fullmatch(b))
    for found in rows.values():
        for (n, _, _), (score, left, h) in found.items():
            if left:
                was = graph.get((n, left, h), (0.0, 0))
                graph[n, left, h] = (max(was[0], score), was[1] + 1)
    scored, patterns = {x: v[0] for x, v in graph.items()}, {}
    for _ in range(60):
        sums, counts = Counter(), Counter()
        for (n, left, h), (_, c) in graph.items():
            sums[n, left] += c * scored[n, left, h]
            counts[n, left] += scored[n, left, h] >= 0.8
        patterns = {x: s / max(met[x[1]], s) for x, s in sums.items() if counts[x] >= 3 and s / max(met[x[1]], s, 1) >= 0.8}
        miss = {}
        for n, left, h in graph:
            if (n, left) in patterns:
                miss[n, h] = miss.get((n, h), 1.0) * max(1 - patterns[n, left], 1e-9)
        scored = {x: max(v[0], 1 - miss.get((x[0], x[2]), 1.0)) for x, v in graph.items()}
    return {x: ",".join(f"{kinds[n]}:{s}:{e}" for s, n, e in sorted((s, n, e) for (n, s, e), (score, left, _) in found.items() if score and n < 4 or (n, left) in patterns)) for x, found in rows.items()}


def check(got, texts):
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (r, joined)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for _, _, k, _ in want) for x in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_real_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op5_pii(spark, "/root/testdata/sf0.01").collect()
    check(got, texts)
    want = brute(list(texts.items()))
    assert all(r["spans"] == want[r["doc_id"], texts[r["doc_id"]] or ""] for r in got)
    assert all((r["n_secret"] > 0) == bool(re.search(r' token = "[0-9a-f]{40}"', texts[r["doc_id"]])) for r in got) and sum(r["n_secret"] for r in got) > 5
    assert all(r["n_spans"] == len(r["spans"].split(",")) * (r["spans"] != "") for r in got)


def test_random_rows(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "@", ".", "1", "25", "300", "+", "+1", " ", "-", "(", ")", "4111111111111111", "é", "😀", "\n", "example.com", "x@y.z", "10.0.0.1", "555", "_", "%", "0"]
    texts = {i: "".join(rng.choices(bits, k=rng.randint(0, 40))) for i in range(1500)}
    texts |= {2000: None, 2001: "", 2002: "1" * 30_000, 2003: "a" * 30_000 + "@", 2004: "1.2." * 8000, 2005: "+1 " * 9000, 2006: "a@b.c " * 3000}
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in texts.items()], "doc_id long, text string, h int, kind string")
    check(find(df).collect(), texts)


def test_bootstrapping_finds_what_follows_confident_words(spark):
    rows = [(i, f"words here. hotline: +1 (212) 555-{7000 + i} and more the {i}{i}") for i in range(12)]
    rows += [(100, "write hotline: 212 555 7788 today"), (101, "the 212 555 7788 of it"), (102, "clean text only"), (103, None), (None, "hotline: 212-555-9911."), (None, "hotline: 212-555-9911.")]
    df = spark.createDataFrame([(i, t, "hit", 9) for i, t in rows], "doc_id long, text string, left string, n_chars long")
    got = {r["doc_id"]: r for r in find(df).collect()}
    assert got[100]["spans"] == "phone:15:27" and got[100]["n_phone"] == 0
    assert got[101]["spans"] == "" and got[102]["spans"] == "" and got[103]["spans"] == "" and got[None]["spans"] == "phone:9:21"
    out = redact(df).collect()
    assert len(out) == len(rows)
    text = {r["doc_id"]: r["text"] for r in out}
    assert text[100] == "write hotline: <phone> today" and text[102] == "clean text only" and text[103] is None and text[None] == "hotline: <phone>."
    assert text[3] == "words here. hotline: <phone> and more the 33"
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)


def test_long_words_before_a_span_and_chains_of_promotions(spark):
    word, rows = "x" * 71, []
    rows += [(k, f"a {word}: +1 (212) 555-{7000 + k} b") for k in range(12)] + [(50, f"a {word}: 212 555 7788 b")]
    # Numbers that one pattern promotes make the next pattern confident, five times over.
    for step in range(5):
        rows += [(100 + 10 * step + k, f"word{'abcdef'[step + d]}: 212 555 {1000 + 10 * (step - 1 + d) + k} z") for d in (0, 1) for k in range(3)]
    rows += [(200 + k, f"worda: +1 212 555 {2000 + k} z") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = find(df).collect()
    assert all(r["spans"] in [want[i, t] for i, t in rows if i == r["doc_id"]] for r in got)
    assert next(r for r in got if r["doc_id"] == 50)["n_spans"] == 1


def test_secrets_only_after_confident_words(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'set api_key = "{key(k)}" here') for k in range(9)] + [(20, "set api_key = AbcDef0123456789xyz now"), (21, f'see "{key(21)}" there'), (22, f"commit {key(22)} done"), (23, None)]
    got = {r["doc_id"]: r["spans"] for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "secret:15:55" and got[20] == "secret:14:33" and got[21] == got[22] == got[23] == ""
    assert got == {i: x for (i, _), x in brute(rows).items()}


def test_empty_table(spark):
    assert find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long, h string")
    assert redact(empty).count() == 0 and redact(empty).columns == empty.columns
