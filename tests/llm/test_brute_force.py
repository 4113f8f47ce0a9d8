"""Operators against plain Python on small, dense fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from onomast.llm import chat, decontaminate, mixing, pii, quality, sharding, simhash, template, tokens, warc
from onomast.sources.scratch import scratch


def frame(spark, texts, **more):
    rows = [(i, t, *(more[k][i] for k in more)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


# --- mixing ---------------------------------------------------------------------------------


def fill(sizes, weights, budget, cap):
    """Water-filling as it is told: share out, cap, share out the rest."""
    target, open_ = {}, set(sizes)
    left = budget * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(5)
    sources = ["b", "a", "é", "Z", None, "aa"]
    texts = ["w " * rng.choice([0, 1, 3, 20, 90]) for _ in range(400)]
    own = [rng.choice(sources[:1] * 5 + sources) for _ in texts]
    got = mixing.taken(frame(spark, texts, source=own)).collect()
    sizes = Counter()
    for t, s in zip(texts, own, strict=True):
        sizes[s] += len(t.split())
    order = [*sorted(s for s in sizes if s is not None), *[None] * (None in sizes)]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = fill(sizes, weights, 1.5, 2.0)
    took = Counter()
    for r in got:
        s = own[r.doc_id]
        assert r.size == len(texts[r.doc_id].split()) and r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        took[s] += r.taken
    for s in sizes:
        assert abs(took[s] - target[s]) <= 45.0  # half the largest document
    again = {r.doc_id: r.taken for r in mixing.taken(frame(spark, texts, source=own)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = Counter(r.doc_id for r in mixing.mix(frame(spark, texts, source=own)).collect())
    assert {d: n * len(texts[d].split()) for d, n in mixed.items() if texts[d].split()} == {d: t for d, t in again.items() if t}


# --- token counts ---------------------------------------------------------------------------


def test_token_counts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab éß\n.1") for _ in range(rng.choice([0, 1, 50, 4000]))) for _ in range(60)] + [None, "", "<|endoftext|>"]
    own = tokens.encoder(tokens.load_ranks(tokens.VOCABULARY), "test")
    want = {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokens.counts(frame(spark, texts)).collect()} == want


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_of_flat_files(spark, tmp_path, block):
    ids = np.array([9, 7, 7, 1, 2, 3, 7, 4, 5, 6, 8, 8, 8, 7, 2], dtype="<u2")
    (tmp_path / "x.tokens").write_bytes(ids.tobytes())
    (tmp_path / "y.tokens").write_bytes(np.array([7], dtype="<u2").tobytes())
    (tmp_path / "z.tokens").write_bytes(b"")
    got = sorted(tuple(r) for r in tokens.scan(spark, str(tmp_path), end=7, block_bytes=block).collect())
    assert got == [("x", 0, 0, 1), ("x", 1, 2, 0), ("x", 2, 3, 3), ("x", 3, 7, 6), ("x", 4, 14, 1), ("y", 0, 0, 0)]


# --- personal data --------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(t - 9 * (t > 9) for t in twice) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "a@b.c+d@e.f", "@", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111-2", "12", " ", "-", "+1 (555) 555-0100", "+1", "(", "é", "𝒳", "x", "_", "%", "9807915762804490", "@b.c.d", "4539578763621486 4539578763621486", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(600)] + ["a" * 30_000 + "@", "1" * 30_000, "1." * 20_000, None, "a@b" + ".c" * 20_000, "+1" + " " * 20_000]
    got = {r.doc_id: r for r in pii.digest(pii.spans(frame(spark, texts), support=10_000)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].spans == ",".join(want), (t, want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_personal_data_from_context(spark):
    """Words that follow the same words as phone numbers do are found; others are not."""
    texts = [f"filler {i} then ring me at +1 (555) 555-0{100 + i} today" for i in range(40)]
    texts += ["please ring me at 555-0199, thanks", "we met at 10:30 then", "chapter 12 says nothing", "ring me at noon"]
    got = {r.doc_id: r for r in pii.digest(pii.spans(frame(spark, texts))).collect()}
    text = texts[40]
    at = text.index("555-0199")
    assert got[40].spans == f"phone:{at}:{at + 8}" and got[40].n_phone == 0
    assert [got[i].spans for i in (41, 42, 43)] == ["", "", ""] and all(got[i].n_phone == 1 for i in range(40))


# --- main text ------------------------------------------------------------------------------


def test_main_text_marked_article():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='</p><article>';</script></head><body><header><h1>Site</h1></header>"
        "<nav><ul><li><a href=/a>A</a></ul></nav><div class='cookie-notice'>We use</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three"
        "<br>four<p>Five &lt;b&gt; &#233;&nbsp;six<div class='ad'>Buy</div><form>Your mail</form><ul><li>i<li>ii</ul><aside>side</aside></article>"
        "<section id=comments><article class=comment><p>Nice!</p></article></section><footer>&copy; me</footer></body></html>"
    )
    want = "Head & line\n\nOne two three four\n\nFive <b> é six\n\ni\n\nii"
    assert template.extract([page]) == [want] and template.extract([page] * 5) == [want] * 5


def test_main_text_without_article():
    page = "<html><body><div id=menu><a>Home</a></div><div class=content><h2>Title {0}</h2><p>Body {0} text<p>More {0}</div><div class=sidebar>x</div><div>All rights</div></body></html>"
    pages = [page.format(f"nr{i}") for i in range(6)]
    assert template.extract(pages) == [f"Title nr{i}\n\nBody nr{i} text\n\nMore nr{i}" for i in range(6)]


def test_copies_without_article_keep_their_text():
    page = "<html><body><nav>n</nav><div><p>Same words here<p>and here</div></body></html>"
    assert template.extract([page] * 6) == ["Same words here\n\nand here"] * 6
    # ... and a single constant line among varying ones is template
    pages = [f"<html><body><div><p>Text {i} of a page<p>Read more</div></body></html>" for i in range(6)]
    assert template.extract(pages) == [f"Text {i} of a page" for i in range(6)]


def test_classes_and_order():
    from onomast.llm.htmltext import events

    pages = [list(events(f"<body><h1>t</h1>{'<p>x</p>' * n}</body>")) for n in (1, 3, 2)]
    classes = {frozenset(p for _, p in c) for c in template.occurrence_classes(pages)}
    assert classes == {frozenset({"/body", "/body/h1"}), frozenset({"/body/p"})}
    assert template.ordered({(0, "a"), (0, "b")}, [[(0, "a"), (0, "b")], [(0, "a"), (0, "b"), (0, "a"), (0, "b")]])
    assert not template.ordered({(0, "a"), (0, "b")}, [[(0, "a"), (0, "b")], [(0, "b"), (0, "a")]])


# --- SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("ABCDEFGH") * 2 + str(rng.randrange(50)) for _ in range(90)) for _ in range(30)]
    texts = [None, "", "one", "One", "one two three"]
    for t in base:
        for _ in range(rng.choice([1, 1, 3, 8])):
            words = t.split()
            words[rng.randrange(len(words))] = "zz"
            texts += [" ".join(words), t]
    got = {r.doc_id: r for r in simhash.groups(frame(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(fps)


def fingerprint_frame(spark, fps):
    return spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) * 2 for f in fps], "node long, f0 long")


def partition_of(roots):
    groups = defaultdict(set)
    for node, root in roots:
        groups[root].add(node)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block", [3, 1 << 20])
@pytest.mark.parametrize("distance", [1, 4])
def test_links_of_dense_and_random_fingerprints(spark, block, distance):
    from onomast.operators.components import components

    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) & (2**64 - 1) for _ in range(150)}
    # Chains that differ in each segment, so that only its neighbours' tables have them.
    for _ in range(15):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(21) ^ 1 << 21 + rng.randrange(21) ^ 3 << 42 + rng.randrange(21)}
    fps = sorted(fps)
    made = simhash.links(fingerprint_frame(spark, fps), simhash.complete_plan(distance), block=block)
    found = {r.node % 2**64: r.root % 2**64 for r in components(made).collect()}
    mine = plain_components(fps, distance)
    assert partition_of(zip(fps, mine, strict=True)) == partition_of((f, found.get(f, f)) for f in fps)


@pytest.mark.parametrize("distance", range(9))
def test_complete_plans_cover_the_distance(distance):
    plan = simhash.complete_plan(distance)
    assert sum(r + 1 for *_, r in plan.segments) == distance + 1
    if distance >= 3:  # balls are enumerated at every size
        assert max(r for *_, r in plan.segments) >= 1


def test_without_balls_links_are_lost(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(50)]
    fps += [f ^ 1 << 5 ^ 1 << 30 ^ 3 << 50 for f in fps]
    plan = simhash.complete_plan(4)
    bare = simhash.Plan(1, 4, tuple((w, s, b, 0) for w, s, b, _ in plan.segments))
    frame_ = fingerprint_frame(spark, fps)
    assert simhash.links(frame_, plan).count() == 50 and simhash.links(frame_, bare).count() == 0


def plain_similar(texts, similarity=0.8, size=5):
    """The smallest row that links of Jaccard similarity reach, for each text."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_one_of_each_keeps_one_of_similar_texts(spark):
    rng = random.Random(8)
    texts = [None, "", "one", "One", "one two three"]
    for _ in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 300]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 5, 9):  # similarities on both sides of 0.8
            words = base[:]
            for _ in range(edits):
                words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    got = sorted(r.doc_id for r in simhash.one_of_each(frame(spark, texts)).collect())
    want = set(plain_similar(texts))
    assert want <= set(got)  # nothing goes that has no similar text
    assert len(set(got) - want) <= 0.02 * len(texts)
    assert 45 < len(want) < len(texts) - 60


def test_one_of_each_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in plain_similar([r.text for r in rows])}
    got = {r.doc_id for r in simhash.one_of_each(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert want <= got and len(got - want) <= 0.02 * (len(rows) - len(want))


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_similar_links_of_a_hot_group(spark, block):
    """Variants of one text, in blocks or not: a forest, never all pairs."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(150):
        words = base[:]
        words[rng.randrange(400)] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(words))
    folder = scratch(spark, "sets")
    sketched = simhash._sketched(frame(spark, texts).toDF("c0", "c1"), 1, 5, folder)
    nodes = sketched.selectExpr("uid as node", "f0", "f1", "f2", "f3", "file", "at", "n")
    from onomast.operators.components import components

    made = simhash.links(nodes, simhash.WIDE, lambda: simhash.Similar(0.8, folder), block=block).cache()
    assert components(made).select("root").distinct().count() == 1 and components(made).count() == 149
    if block > 16:
        assert made.count() <= 24 * 149


# --- WARC -----------------------------------------------------------------------------------


def test_archives_stream_in_chunks(spark):
    rows = [(1, "http://x/1", "é" * 1200), (9, "http://x/9", "é" * 1200), (3, None, "small"), (4, "http://x/4", "small"), (5, "u", "z" * 10_001)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(pages)
    parts = warc.chunks(archives, chunk_bytes=1000).orderBy("path", "record_no", "chunk_no").collect()
    whole = defaultdict(bytes)
    for r in parts:
        whole[r.page_id] += bytes(r.data)
        assert r.start + len(r.data) == len(whole[r.page_id]) and len(r.data) <= 1000
        assert r.digest == hashlib.sha1(whole[r.page_id]).hexdigest()
    assert whole[9].decode() == "é" * 1200 and whole[1] == b"" and whole[5] == b"z" * 10_001
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.intact) for r in warc.records(archives, 1000).collect()}
    digest = hashlib.sha1(("é" * 1200).encode()).hexdigest()
    assert got[1] == ("revisit", 9, 2400, digest, True) and got[9] == ("response", None, 2400, digest, True)
    assert got[3][:2] == got[4][:2] == ("response", None)


# --- chat -----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    bits = ["<s>", "</s>", "<\\/s>", "\\", "[INST]", "[/INST]", "[\\\\ROLE]", "[/ROLE]", "<<SYS>>", "<", "[", "/s>", "ok", "\n", "é", " ", "$1", "ROLE]"]
    rng = random.Random(4)
    talks = {c: [(rng.choice(["user", "assistant", "<s>", "a[/ROLE]b", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 7))] for c in range(150)}
    rows = [(c, k, role, text) for c, turns in talks.items() for k, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    t = chat.Template()
    rendered = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    read = rendered.select("conv_id", chat.parse(F.col("formatted"), t).alias("turns"), "formatted", "mask", "escaped").collect()
    assert len(read) == len(talks)
    for r in read:
        turns = talks[r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert sum(x.n_chars for x in r["mask"]) == len(r.formatted)
        at, learned = 0, []
        for x in r["mask"]:
            if x.in_loss:
                learned.append(r.formatted[at : at + x.n_chars])
            at += x.n_chars
        assert [re.sub(t.pattern.replace(r"(\\*)", r"\\(\\*)"), r"\1\2\3", s) for s in learned] == [text for role, text in turns if role == "assistant"]
        plain = all(not re.search(t.pattern, role + text) for role, text in turns)
        assert (r.escaped == 0) == plain
    for r in chat.summary(rendered).collect():
        lines = "".join(f"{role}\n{text}\n" for role, text in talks[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest() and r.n_turns == len(talks[r.conv_id])


# --- decontamination ------------------------------------------------------------------------


def plain_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, marks, names = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    marks.update(range(j, j + n))
                    names.add(str(item))
    return len(words), len(marks), sorted(names)


@pytest.mark.parametrize("block_words", [1, 4_000_000])
def test_decontamination(spark, block_words):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "C", "d-e", "é", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 10, 11, 14])))) for i in range(12)] + [(3, "zz"), (77, None)]
    texts = [" ".join([word() for _ in range(rng.randrange(40))] + [rng.choice(items)[1] or ""] + [word() for _ in range(9)]) for _ in range(60)] + ["ZZ! zz", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), bench, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        n, hit, names = plain_hits(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, names, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    kept = sorted(r.doc_id for r in decontaminate.clean(frame(spark, texts), bench, block_words=block_words).collect())
    assert kept == [i for i, t in enumerate(texts) if not plain_hits(t, items)[1]]


# --- quality --------------------------------------------------------------------------------


def plain_quality(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {k for i in range(n - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    covered = {k for i in range(n) if longest[i] >= rules.min_repeat for k in range(i, i + longest[i])}
    top = max(longest, default=0)
    top = top if top >= rules.min_repeat else 0
    failed = n < rules.min_words or 100 * len(repeated) > rules.max_repeat_pct * n
    kept = not failed and len(covered) <= rules.max_covered * n and top <= rules.max_longest
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), failed, len(covered), top, kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c é #x <y> \n \n\n \x0b zz zz\n".split(" ")), max_size=60).map(" ".join), max_size=6), st.sampled_from([2, 3, 5, 8]))
def test_quality(texts, least):
    rules = quality.QualityRules(min_words=5, min_repeat=least, max_longest=12)
    out = quality.measure([*texts, None], rules)
    for i, t in enumerate([*texts, None]):
        got = tuple(out[k][i] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept"))
        assert got == plain_quality(t, rules), (t, got)
        assert sum(s["end"] - s["start"] for s in out["repeat_spans"][i]) == out["covered_words"][i]


# --- sharding -------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [200, 1000, 10**9])
def test_sharding(spark, limit):
    rng = random.Random(8)
    texts = ["x" * rng.choice([0, 5, 50, 150]) for _ in range(500)] + ["y" * 5000]
    docs = frame(spark, texts)
    copies = docs.where("doc_id = 1").select(F.lit(1000).cast("long").alias("doc_id"), F.lit("z" * 90).alias("text"))
    docs = docs.union(copies.crossJoin(spark.range(40)).select("doc_id", "text"))
    rows, directory = sharding.shards_of(docs, limit=limit)
    got = rows.collect()
    assert len(got) == 541 and all(r.shard is not None for r in got)
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.bytes
        count[r.shard] += 1
    assert all(size[s] <= limit or count[s] == 1 for s in size)
    told = {(r.level, r.depth, r.prefix, r.base): r for r in directory.collect()}
    assert len(told) == len(size) and sum(r.bytes for r in told.values()) == sum(size.values())
    if limit == 10**9:
        assert len(size) == 1
    # Only oversized buckets split: the two halves of any split do not fit together.
    parents = defaultdict(int)
    for r in told.values():
        parents[(r.level, r.base, r.depth - 1, r.prefix >> 1)] += r.bytes
    whole = {(r.level, r.base, r.depth - 1, r.prefix >> 1) for r in told.values() if (r.level, r.depth, r.prefix ^ 1, r.base) in told}
    assert all(parents[p] > limit for p in whole if p[2] >= 0)
