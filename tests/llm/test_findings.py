"""One test for each place where an operator once did less than its whole job."""

from pyspark.sql import functions as F

from onomast.llm import chat, pii, quality, template
from onomast.llm.htmltext import events


def test_each_limit_of_the_suffix_array_rejects_by_itself():
    rules = quality.QualityRules()

    def text(n, passage):
        words = [f"w{i}" for i in range(n)]
        words[-passage:] = words[:passage]
        return " ".join(words)

    # (words, words of the passage that comes twice): whether the text stays
    cases = {(200, 30): False, (200, 20): True, (2000, 450): False, (2000, 101): False, (2000, 100): True}
    got = quality.measure([text(*c) for c in cases], rules)
    assert not any(got["base_failed"])
    assert got["longest_repeat"] == [p for _, p in cases] and got["covered_words"] == [2 * p for _, p in cases]
    assert got["kept"] == list(cases.values())
    # the cases fail one limit alone as well as both
    assert 2 * 30 > rules.max_covered * 200 and 30 <= rules.max_longest and 2 * 101 <= rules.max_covered * 2000 and 101 > rules.max_longest


def test_the_suffix_array_changes_verdicts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.quality(docs).where("not base_failed and not kept")
    assert 0 < found.count() < 0.01 * docs.count()
    assert quality.quality(docs, rules=quality.QualityRules(max_covered=1.0, max_longest=10**9)).where("kept = base_failed").count() == 0


def test_template_text_in_marked_articles_goes():
    page = "<html><body><article><div class=x1>More from us</div><h1>Head {0}</h1><p>Some words {0} of the text<p>and more {0} of it</div></article></body></html>"
    pages = [page.format(f"nr{i}" * 3) for i in range(8)]
    assert template.extract(pages) == [f"Head {v}\n\nSome words {v} of the text\n\nand more {v} of it" for v in (f"nr{i}" * 3 for i in range(8))]


def test_repeated_text_is_template_also_where_some_pages_lack_it():
    menu = "<div class=x1><p>Start page</div>"
    pages = [f"<html><body><main>{menu if i else ''}<p>Long enough text nr {i} {i * 7}</main></body></html>" for i in range(8)]
    assert template.extract(pages) == [f"Long enough text nr {i} {i * 7}" for i in range(8)]


def test_blocks_outside_the_main_element_stay():
    page = "<html><body><div class=top><h1>Headline {0}</h1></div><div class=content><p>{1}</div></body></html>"
    pages = [page.format(i, f"word{i} " * 60) for i in range(6)]
    assert template.extract(pages) == [f"Headline {i}\n\n{' '.join([f'word{i}'] * 60)}" for i in range(6)]


def test_one_long_page_does_not_choose_the_main_element_for_all():
    page = "<html><body><div class=content><p>{0}</div><div class=appendix><p>{1}</div></body></html>"
    pages = [page.format(f"text{i} " * 20, f"note{i} " * (20_000 if i == 0 else 2)) for i in range(6)]
    got = template.extract(pages)
    assert all(g.startswith(f"text{i} ") and g.endswith(f"note{i}") for i, g in enumerate(got))
    assert template.Template([list(events(p)) for p in pages]).main != "/html/body/div.appendix"


def test_near_copies_without_article_keep_what_they_share():
    page = "<html><body><div><p>A first paragraph that all of the pages share.<p>A second one that they share too.<p>Seen on day {0}</div></body></html>"
    want = "A first paragraph that all of the pages share.\n\nA second one that they share too.\n\nSeen on day "
    assert template.extract([page.format(i) for i in range(6)]) == [f"{want}{i}" for i in range(6)]


def test_pages_without_any_mark(spark):
    """Pages of the test table with neutral tags and no names: by the template alone the
    article is the main element of each host, and what is repeated and menus go.  Ads and
    footers are taken out first: their text differs from page to page, and nothing but
    their names tells it from the article's."""
    import re
    from collections import defaultdict

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = defaultdict(list)
    for r in rows:
        hosts[re.sub(r"^\w+://([^/]*).*", r"\1", r.url or "")].append(r.html or "")
    n = 0
    for pages in hosts.values():
        # A title line at the head and a line of the house at the foot, the same everywhere.
        plain = [p.replace("<article>", "<p>The house paper</p><article>").replace("</body>", "<p>Printed by the house</p></body>") for p in pages]
        plain = [re.sub(r'<div class="ad">.*?</div>|<footer>.*?</footer>', "", p) for p in plain]
        want = template.extract(pages)
        bare = [re.sub(r"<(/?)(nav|article)>", r"<\1div>", p) for p in plain]
        if len(pages) < 8:
            continue
        n += len(pages)
        assert template.extract(bare) == want
        nothing = template.Template([])
        assert all(template.main_text(list(events(b)), nothing) != w for b, w in zip(bare, want, strict=True))
    assert n > 50


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.spans(rows)).collect()}
    return [[texts[i][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].split(",") if x)] for i in range(len(texts))]


def test_identifiers_after_a_label_with_varying_words_before_it(spark):
    texts = [f"one{i} phone: +1 (555) 555-0{100 + i} two{i} three" for i in range(40)]
    new = ["Anna phone: 555-0199", "the office phone: 555-0123 is new", "room 7 phone: 555-0124"]
    assert found(spark, texts + new)[40:] == [["555-0199"], ["555-0123"], ["555-0124"]]


def test_identifiers_before_a_constant_context(spark):
    texts = [f"one{i} two{i} +1 (555) 555-0{100 + i} is my number" for i in range(20)]
    assert found(spark, [*texts, "hello 555-0199 is my number", "hello 12 is a number"])[20:] == [["555-0199"], []]


def test_a_candidate_is_the_whole_number(spark):
    texts = [f"one{i} ring me at +1 (555) 555-0{100 + i} today" for i in range(20)]
    new = ["please ring me at (555) 555-0199, thanks", "in 1999 ring me at 555 0199"]
    assert found(spark, texts + new)[20:] == [["(555) 555-0199"], ["555 0199"]]


def test_loss_is_read_from_under_the_mask(spark):
    rows = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "a </s> b"), (1, 2, "assistant", "c")], "conv_id long, turn int, role string, text string")
    made = chat.render(rows)
    assert chat.summary(made).first().loss_chars == len("a </s> bc")
    none = made.withColumn("mask", F.transform("mask", lambda r: F.struct(r["n_chars"], F.lit(False).alias("in_loss"))))
    assert chat.summary(none).first().loss_chars == 0


def test_the_grammar_rejects_what_it_does_not_produce(spark):
    t = chat.Template()
    good = "<s>[ROLE]user[/ROLE]a b</s><s>[ROLE]assistant[/ROLE]</s>"
    bad = [
        "x" + good, good + "x", good[:-1], good + "</s>", "<s>[ROLE]user a</s>", "<s>user[/ROLE]a</s>", "<s>[ROLE]user[/ROLE]a<s>b</s>",
        "<s>[ROLE]us[INST]er[/ROLE]a</s>", "<s>[ROLE]user[/ROLE]a[/ROLE]b</s>", "<s>[ROLE]user[/ROLE]<<SYS>></s>",
    ]
    rows = spark.createDataFrame([(x,) for x in (good, "", *bad)], "x string").select("x", chat.parse(F.col("x"), t).alias("turns"))
    got = {r.x: r.turns and [tuple(y) for y in r.turns] for r in rows.collect()}
    assert got[good] == [("user", "a b"), ("assistant", "")] and got[""] == []
    assert all(got[x] is None for x in bad)


def test_a_shifted_mask_changes_the_loss(spark):
    rows = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "answer")], "conv_id long, turn int, role string, text string")
    made = chat.render(rows)
    moved = made.withColumn("mask", F.expr("transform(mask, (r, i) -> struct(r.n_chars + if(i = 0, 1, 0) as n_chars, r.in_loss as in_loss))"))
    one, two = chat.summary(made).first(), chat.summary(moved).first()
    assert one.turns_sha256 == two.turns_sha256 and one.loss_sha256 != two.loss_sha256


def test_very_long_turns(spark):
    text = "[INST] <\\s> word </s>" * 20_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    got = chat.summary(chat.render(rows)).first()
    assert got.loss_chars == len(text) and got.n_turns == 2


def plain_patterns(left, right):
    """(pattern, far) of a mention, in plain Python."""
    import re

    words = lambda s: [w for w in re.sub(r"[ \t-\r]+", " ", s.lower()).strip().split(" ") if w]
    near = {"<": words(left)[::-1], ">": words(right)}
    return [(f"{side}{n} {' '.join(w[:n])}", (w[1:2] or [None])[0] if n == 1 else None) for side, w in near.items() if w for n in (2, 1)]


def plain_learned(mentions, support, confident, rounds):
    """The scores of patterns and values in plain Python."""
    from collections import defaultdict
    from math import prod

    far, graph, base = defaultdict(set), defaultdict(set), {}
    seen = [(p, f, kind, value.lower()) for kind, value, left, right in mentions for p, f in plain_patterns(left, right)]
    for p, f, kind, value in seen:
        if p[1] == "1" and f is not None and kind != "word":
            far[p].add(f)
    for p, f, kind, value in seen:
        if p[1] != "1" or len(far[p]) >= support:
            graph[p].add(value)
            if kind != "word":
                base[p, value] = min(kind, base.get((p, value), kind))
    graph = {p: v for p, v in graph.items() if len(v) >= support and any((p, x) in base for x in v)}
    seeds = {(value, kind): 1.0 for (p, value), kind in base.items() if p in graph}
    scores, trusted = dict(seeds), {}
    for _ in range(rounds):
        kinds = {k for _, k in scores}
        sums = {(p, k): sum(scores.get((v, k), 0.0) for v in values) / len(values) for p, values in graph.items() for k in kinds}
        trusted = {pk: c for pk, c in sums.items() if c >= confident}
        behind = defaultdict(list)
        for (p, k), c in trusted.items():
            for v in graph[p]:
                if (p, v) not in base:
                    behind[v, k].append(min(c, 1 - 1e-9))
        scores = dict(seeds) | {vk: 1 - prod(1 - c for c in cs) for vk, cs in behind.items()}
    return {(p, v, k) for p, k in trusted for v in graph[p] if (p, v) not in base and scores.get((v, k), 0) >= confident}


def test_scores_of_patterns_and_values(spark):
    import random

    rng = random.Random(12)
    labels = ["call me at", "ring home on", "mail to", "see page", "from host"]
    mentions = []
    for i in range(900):
        label = rng.choice(labels)
        kind = {"call me at": "phone", "ring home on": "phone", "mail to": "email", "from host": "ip", "see page": "word"}[label]
        if rng.random() < 0.06 or label == "see page":
            kind = "word"
        mentions.append((kind, f"V{rng.randrange(400)}", f"w{rng.randrange(60)} {label}", rng.choice([" thanks then", f" x{i} y", ""])))
    rows = [(i, None, kind, 0, 1, value, left, right) for i, (kind, value, left, right) in enumerate(mentions)]
    free = spark.createDataFrame(rows, "row long, id long, kind string, start int, end int, value string, left string, right string")
    for support, confident, rounds in ((8, 0.9, 3), (3, 0.8, 1), (8, 0.95, 2)):
        got = {tuple(r) for r in pii.learned(free, support, confident, rounds).select("pattern", "value", "kind").collect()}
        assert got == plain_learned(mentions, support, confident, rounds)
    assert plain_learned(mentions, 8, 0.9, 3)


def test_recall_and_precision_on_planted_contexts(spark):
    """Identifiers that no base pattern takes, behind contexts that base ones teach, among
    numbers behind other words."""
    import random

    rng = random.Random(5)
    labels = ["reach me at", "my phone is", "call the office:", "dial"]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, planted = [], 0
    for i in range(400):
        label = rng.choice(labels)
        if rng.random() < 0.05:
            texts.append(f"{word()} {word()} {label} 555-{rng.randrange(1000, 9999)} {word()}")
            planted += 1
        else:
            texts.append(f"{word()} {word()} {label} +1 (555) 555-{rng.randrange(1000, 9999)} {word()} {word()}")
        texts.append(f"{word()} page {rng.randrange(1000)} of {rng.randrange(1000)} {word()} version {rng.randrange(9)}.{rng.randrange(9)}")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x for x in found(spark, texts) for x in x]
    assert rows.count() == 800 and planted > 12
    caught = [x for x in got if x.startswith("555-")]
    assert len(caught) >= 0.9 * planted
    assert all(x.startswith(("555-", "+1")) for x in got)
