"""Own cases for each kind of name: forms, particles, titles, scripts, rejects and pairs."""

import unicodedata

import pytest

from onomast.kernel.match import consistent
from onomast.kernel.parse import parse
from onomast.kernel.tables import GENERATION_NAMES, TITLES

#: kind -> (text, given names, surname, initials, generation, prefix, credentials)
CASES = {
    "order, titles, initials and generations of one name": [
        ('Nora Quist', 'Nora', 'Quist', 'N', None, None, None),
        ('Quist, Nora', 'Nora', 'Quist', 'N', None, None, None),
        ('Dr. Nora Quist', 'Nora', 'Quist', 'N', None, 'Dr.', None),
        ('Quist, Dr. Nora', 'Nora', 'Quist', 'N', None, 'Dr.', None),
        ('Nora B. Quist', 'Nora', 'Quist', 'NB', None, None, None),
        ('Quist, Nora B.', 'Nora', 'Quist', 'NB', None, None, None),
        ('N. B. Quist', '', 'Quist', 'NB', None, None, None),
        ('NB Quist', '', 'Quist', 'NB', None, None, None),
        ('Nora Quist III', 'Nora', 'Quist', 'N', 'III', None, None),
        ('Quist, Nora, III', 'Nora', 'Quist', 'N', 'III', None, None),
        ('Quist III, Nora', 'Nora', 'Quist', 'N', 'III', None, None),
        ('Dr Nora B Quist Sr', 'Nora', 'Quist', 'NB', 'Sr.', 'Dr.', None),
        ('NORA QUIST JR', 'Nora', 'Quist', 'N', 'Jr.', None, None),
        ('nora quist', 'Nora', 'Quist', 'N', None, None, None),
    ],
    "particles and conjunctions": [
        ('Pia van den Broek', 'Pia', 'van Den Broek', 'P', None, None, None),
        ('van den Broek, Pia', 'Pia', 'van Den Broek', 'P', None, None, None),
        ('PIA VAN DEN BROEK', 'Pia', 'van Den Broek', 'P', None, None, None),
        ('pia van den broek', 'Pia', 'van Den Broek', 'P', None, None, None),
        ('Pia de la Fuente', 'Pia', 'de la Fuente', 'P', None, None, None),
        ('Pia Vega y Luna', 'Pia', 'Vega y Luna', 'P', None, None, None),
        ('Pia B. Vega e Luna', 'Pia', 'Vega e Luna', 'PB', None, None, None),
        ('Dr. Pia von der Tann III', 'Pia', 'von der Tann', 'P', 'III', 'Dr.', None),
        ('Pia Della Rovere', 'Pia', 'Della Rovere', 'P', None, None, None),
        ('Abu Bakr Said', 'Abu Bakr', 'Said', 'AB', None, None, None),
        ('Pia El Sayed', 'Pia', 'El Sayed', 'P', None, None, None),
    ],
    "accents and apostrophes": [
        ('Zoé O’Hara', 'Zoé', 'O’Hara', 'Z', None, None, None),
        ("zoé d'arcy", 'Zoé', "D'Arcy", 'Z', None, None, None),
        ('Þóra Jónsdóttir', 'Þóra', 'Jónsdóttir', 'Þ', None, None, None),
        ('Ignacio Ñíguez', 'Ignacio', 'Ñíguez', 'I', None, None, None),
        ('Łukasz Żak', 'Łukasz', 'Żak', 'Ł', None, None, None),
    ],
    "use of middle names": [
        ('N. Paige Quist', 'Paige', 'Quist', 'NP', None, None, None),
        ('N. Paige B. Quist', 'Paige', 'Quist', 'NPB', None, None, None),
        ('Nora Paige Beth Quist', 'Nora Paige Beth', 'Quist', 'NPB', None, None, None),
        ('Quist, N. Paige', 'Paige', 'Quist', 'NP', None, None, None),
    ],
    "titles and credentials": [
        ('Maharajah Ranjit Singh', 'Ranjit', 'Singh', 'R', None, 'Maharajah', None),
        ('Senior Judge Nora Quist', 'Nora', 'Quist', 'N', None, 'Senior Judge', None),
        ('The Right Rev. Nora Quist', 'Nora', 'Quist', 'N', None, 'The Right Rev.', None),
        ('Lt Col Nora Quist', 'Nora', 'Quist', 'N', None, 'Lt. Col.', None),
        ('Her Majesty Queen Nora Quist', 'Nora', 'Quist', 'N', None, 'Her Majesty Queen', None),
        ('Nora Quist, CPA, MBA', 'Nora', 'Quist', 'N', None, None, 'CPA MBA'),
        ('Nora Quist PhD', 'Nora', 'Quist', 'N', None, None, 'Ph.D.'),
        ('Quist, Nora, MD', 'Nora', 'Quist', 'N', None, None, 'MD'),
        ('Matron Nora Quist', 'Nora', 'Quist', 'N', None, 'Matron', None),
        ('Hajji Omar Said', 'Omar', 'Said', 'O', None, 'Hajji', None),
        ('Commander-In-Chief Nora Quist', 'Nora', 'Quist', 'N', None, 'Commander-In-Chief', None),
        ('Vice Admiral N. Quist', '', 'Quist', 'N', None, 'Vice Adm.', None),
    ],
    "other words": [
        ('Nora Quist & Co', 'Nora', 'Quist', 'N', None, None, '& Co'),
        ('Nora Quist et al', 'Nora', 'Quist', 'N', None, None, 'et al.'),
        ('Nora Quist, Ed.', 'Nora', 'Quist', 'N', None, None, 'Ed.'),
        ('Quist, Nora (ed.)', 'Nora', 'Quist', 'N', None, None, None),
    ],
    "generations": [
        ('Nora Quist 2nd', 'Nora', 'Quist', 'N', 'Jr.', None, None),
        ('Nora Quist, junior', 'Nora', 'Quist', 'N', 'Jr.', None, None),
        ('Nora Quist IV', 'Nora', 'Quist', 'N', 'IV', None, None),
        ('Quist Jr., Nora B.', 'Nora', 'Quist', 'NB', 'Jr.', None, None),
        ('Nora V Quist', 'Nora', 'Quist', 'NV', None, None, None),
        ('Nora Quist V', 'Nora', 'Quist', 'N', 'V', None, None),
    ],
    "short words": [
        ('Ed Quist', 'Ed', 'Quist', 'E', None, None, None),
        ('Nora Li', 'Nora', 'Li', 'N', None, None, None),
        ('Bo Li', 'Bo', 'Li', 'B', None, None, None),
        ('Jo B. Quist', 'Jo', 'Quist', 'JB', None, None, None),
        ('nora ng', 'Nora', 'Ng', 'N', None, None, None),
        ('Al Quist', 'Al', 'Quist', 'A', None, None, None),
    ],
    "nicknames and brackets": [
        ("Nora 'Nono' Quist", 'Nora', 'Quist', 'N', None, None, None),
        ('Nora "Nono" Quist', 'Nora', 'Quist', 'N', None, None, None),
        ('Nora (Nono) Quist', 'Nora', 'Quist', 'N', None, None, None),
        ('Nora [x] Quist', 'Nora', 'Quist', 'N', None, None, None),
        ('Nora Quist (died)', 'Nora', 'Quist', 'N', None, None, None),
    ],
    "capitals": [
        ('NORA MCNALLY', 'Nora', 'McNally', 'N', None, None, None),
        ('nora mcnally', 'Nora', 'McNally', 'N', None, None, None),
        ('Nora MacNally', 'Nora', 'MacNally', 'N', None, None, None),
        ("NORA O'HARA-QUIST", 'Nora', "O'Hara-Quist", 'N', None, None, None),
        ('nora b quist', 'Nora', 'Quist', 'NB', None, None, None),
        ('Nora LI', 'Nora', 'Li', 'N', None, None, None),
    ],
    "other scripts": [
        ('李 明', '李', '明', '李', None, None, None),
        ('李明', '李', '明', '李', None, None, None),
        ('Νόρα Κουίστ', 'Νόρα', 'Κουίστ', 'Ν', None, None, None),
        ('نورا سعيد', 'نورا', 'سعيد', 'ن', None, None, None),
        ('Нора Квист', 'Нора', 'Квист', 'Н', None, None, None),
    ],
    "initials and spaces": [
        ('N.B.C. Quist', '', 'Quist', 'NBC', None, None, None),
        ('N.-B. Quist', '', 'Quist', 'NB', None, None, None),
        ('Nora-Beth Quist', 'Nora-Beth', 'Quist', 'NB', None, None, None),
        ('Nora  Quist', 'Nora', 'Quist', 'N', None, None, None),
        ('N.Quist', '', 'Quist', 'N', None, None, None),
        ('Quist,Nora', 'Nora', 'Quist', 'N', None, None, None),
        ('N B C D Quist', '', 'Quist', 'NBCD', None, None, None),
        ('ﬁona Quist', 'Fiona', 'Quist', 'F', None, None, None),
    ],
}
REJECTS = ['Nora', 'Quist Jr.', 'Dr. Quist', 'xkcd', 'n b q', 'NBQ', 'nora@quist.org', '--- ---', '42 17', '明', '🦉 🦉', 'q.', 'Mrs. Quist', '']
#: (name, name, whether they may be of one person)
PAIRS = [
    ('Nora Quist', 'N. Quist', True),
    ('Nora Quist', 'N. B. Quist', True),
    ('Nora B. Quist', 'Nora Beth Quist', True),
    ('Nora Beth Quist', 'Nora Ann Quist', False),
    ('N. Beth Quist', 'Beth Quist', True),
    ('N. Beth Quist', 'Nora Quist', True),
    ('Beth Quist', 'Nora Quist', False),
    ('N. B. Quist', 'N. C. Quist', False),
    ('B. Quist', 'N. B. Quist', False),
    ('Zoé Ñíguez', 'Zoe Niguez', True),
    ('Pia Vega-Luna', 'Pia Luna', True),
    ('Pia Vega-Luna', 'Pia Vega', False),
    ('Pia van den Broek', 'Pia Vandenbroek', True),
    ("Pia O'Hara", 'Pia OHara', True),
    ('Nora Li', 'Nora Lu', False),
    ('Nora Li', 'N Li', True),
    ('Nora-Beth Quist', 'Nora Quist', True),
    ('Nora-Beth Quist', 'Norabeth Quist', True),
    ('Nora-Beth Quist', 'Nora-Ann Quist', False),
    ('Bill Quist', 'William Quist', True),
    ('Peggy Quist', 'Margaret Quist', True),
    ('Peggy Quist', 'Katherine Quist', False),
    ('Chuck Quist', 'Charles B. Quist', True),
    ('Tina Quist', 'Martina Quist', True),
    ('Alexandra Quist', 'Alexander Quist', False),
    ('Nora Quist Jr.', 'Nora Quist', True),
    ('Nora Quist Jr.', 'Nora Quist Sr.', False),
    ('Nora Quist Jr.', 'Nora Quist II', True),
    ('Dr. Nora Quist', 'Nora Quist, PhD', True),
    ('Nora Quist', 'Nora Quint', False),
    ('Нора Квист', 'Nora Kvist', True),
    ('Jean Paul Quist', 'Jeanpaul Quist', True),
    ('J. P. Quist', 'Jean-Paul Quist', True),
    ('Nora Quist', 'Quist, Nora', True),
    ('NORA QUIST', 'nora quist', True),
    ('Nora B Quist', 'Nora C. Quist', False),
    ('Josef Quist', 'Joseph Quist', False),
    ('Nor Quist', 'Nora Quist', False),
    ('N. Quist', 'M. Quist', False),
]


def plain(text):
    return text and unicodedata.normalize("NFC", text)


@pytest.mark.parametrize("kind", CASES)
def test_cases(kind):
    for text, *want in CASES[kind]:
        n = parse(text)
        generation = GENERATION_NAMES[n.generation - 1] if n.generation else None
        got = [" ".join(n.given_words), " ".join(n.surname_words), n.initials, generation, n.honorific_prefix, n.honorific_suffix]
        assert list(map(plain, got)) == want, text


@pytest.mark.parametrize("text", REJECTS)
def test_rejects(text):
    assert parse(text) is None


@pytest.mark.parametrize(("a", "b", "same"), PAIRS)
def test_pairs_both_ways(a, b, same):
    x, y = parse(a), parse(b)
    assert consistent(x, y) is same and consistent(y, x) is same
    assert not same or x.surname_key == y.surname_key


def test_every_word_of_the_vocabulary_is_a_title():
    assert len(TITLES) == 442
    for word, written in TITLES.items():
        # Words without a vowel, and capitals of up to five letters, are taken for initials.
        if len(word) > 3 and word.isalpha() and word.isascii() and set(word.lower()) & set("aeiou") and word not in ("Junior", "Senior"):
            n = parse(f"{word} Nora Quist")
            assert (n.honorific_prefix, n.given_words, n.surname_words) == (written, ["Nora"], ["Quist"]), word


def test_spark_parses_as_the_kernel_does(spark):
    """The native path and the SQL functions against the kernel, on every case."""
    from pyspark.sql import functions as F

    from onomast.functions import names_consistent, parse_name, register

    register(spark)
    texts = [c[0] for cases in CASES.values() for c in cases] + REJECTS + [t for a, b, _ in PAIRS for t in (a, b)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    rows.createOrReplaceTempView("golden")
    kernel = rows.select("i", parse_name("t", fast=False).alias("p"))
    want = [p and p.asDict(recursive=True) for _, p in sorted((r.i, r.p) for r in kernel.collect())]
    for found in (rows.select("i", parse_name("t").alias("p")), spark.sql("SELECT i, parse_name(t) AS p FROM golden")):
        got = {r.i: r.p and r.p.asDict(recursive=True) for r in found.collect()}
        assert [got[i] for i in range(len(texts))] == want
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i long, a string, b string")
    pairs = pairs.select("i", parse_name("a").alias("a"), parse_name("b").alias("b"))
    got = {r.i: (r.x, r.y) for r in pairs.select("i", names_consistent("a", "b").alias("x"), F.expr("names_consistent(a, b)").alias("y")).collect()}
    assert [got[i] for i in range(len(PAIRS))] == [(same, same) for *_, same in PAIRS]


def test_sql_functions_decide_plain_names_natively(spark):
    from onomast.functions import register

    register(spark)
    plan = spark.sql("SELECT name_surname(parse_name(concat('Nora Quist', id))) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" in plan and plan.count("ArrowEvalPython") == 1
