"""The rules on texts, case by case."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, scope
from tessera.functions import text as t
from tessera.operators import chunking, lookup


def answers(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", column(F.col("text")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_property_tax(spark):
    yes = ["Which property tax falls due on a house that I live in?", "UIPT on a shop, even if rented", "Who collects urban immovable property tax in a town?", "ghar par property tax har saal kitna hai", "مکان کا جائیداد ٹیکس ہر سال", "پراپرٹی  ٹیکس کب دینا ہے"]
    no = ["property tax when a plot is bech diya", "Does a buyer owe property tax on the purchase?", "property tax on kiraya of a flat", "پراپرٹی ٹیکس مکان بیچنے پر", "Our property. Tax or none?", "property tax under 236C", ""]
    assert answers(spark, yes + no, scope.provincial_property_tax) == [True] * len(yes) + [False] * len(no)


def test_sales_tax(spark):
    yes = ["Where do I file with SRB?", "forms of the Balochistan Revenue Authority", "a restaurant's sales tax", "salestax for services in a salon", "پنجاب ریونیو بورڈ کا فارم", "خدمات پر سیلز ٹیکس", "خیبر پختونخوا ریونیو اتھارٹی"]
    no = ["withholding on services in Sindh with sales tax", "tax on services", "income tax on what PRA refunds", "a bra shop's levy", "sales tax on goods", "انکم ٹیکس اور سیلز ٹیکس خدمات پر"]
    assert answers(spark, yes + no, scope.provincial_sales_tax) == [True] * len(yes) + [False] * len(no)


def test_future_budget(spark):
    yes = ["Will the upcoming national budget raise slabs?", "new budget and my pay", "aglay saal ka budget", "aane wale budget me kya hoga", "اگلے سال کے بجٹ میں", "نئے بجٹ"]
    no = ["What did last year's budget change?", "nayi gaari, purana budget", "the budget is next", ""]
    assert answers(spark, yes + no, scope.future_budget) == [True] * len(yes) + [False] * len(no)


def test_filer(spark):
    assert answers(spark, ["non-filer rate", "the ATL", "active taxpayers' list", "Active Tax Payer's List", "فائلر کون ہے", "profile", "atlas"], scope.filer_question) == [True] * 5 + [False] * 2


@pytest.mark.parametrize(("text", "year"), [("tax year 2025", 2025), ("TY2024 rates", 2024), ("ty-2026", 2026), ("2024-25", 2025), ("2000-50", None), ("2023/24 return", 2024), ("ٹیکس سال ۲۰۲۶", 2026), ("tax saal 2027", 2027), ("bought in 2025", None)])
def test_tax_year(spark, text, year):
    assert answers(spark, [text], t.tax_year) == [year]


def test_a_date_is_no_tax_year(spark):
    texts = ["We moved in March 2025 and sold the flat later", "budget of 2025", "2025 wali return", "the range 2024-25", "سال 2025 میں"]
    assert answers(spark, texts, lambda c: t.written_as_tax_year(c, F.lit(2025))) == [False, True, True, True, True]


def test_references(spark):
    texts = ["sections 31 and 32", "pay 31 hai", "u/s 236k, Sec. 4ab and Section 4AB", "section no. 9f with rule 8", "daf'a 12", "section149", "subsection 9", "section 1234"]
    want = [["section 31"], [], ["section 236K", "section 4AB"], ["section 9F", "rule 8"], ["section 12"], ["section 149"], [], []]
    assert [[f"{r['kind']} {r['number']}" for r in x] for x in answers(spark, texts, t.references)] == want


def test_amending_laws(spark):
    cases = {
        "Substituted by the Finance Act, 2025. The earlier text read as follows: as inserted by Finance Act, 2010": ["Finance Act, 2025"],
        "Added by the Finance Act 2019 and amended by S.R.O. 389(I)/2009": ["Finance Act, 2019", "SRO 389(I)/2009"],
        "Inserted by the Tax Law (second amendment) Ordinance, 2021": ["Tax Laws (Second Amendment) Ordinance, 2021"],
        "See Income Tax Ordinance, 2001": [], "": [],
        "Finance Supplementary (Amendment) Act, 2018 then Finance Act, 2022 then Finance Act, 2022": ["Finance Act, 2022", "Finance Supplementary (Amendment) Act, 2018"],
        "S.R.O.428(1)/2002 by Presidential Order No. 3 of 1990 and SRO No. 516 (I)/2006": ["SRO 516(I)/2006", "SRO 428(I)/2002", "Presidential Order No. 3"],
        "under a Presidential Order": ["Presidential Order"],
    }
    assert answers(spark, list(cases), t.amending_laws) == list(cases.values())


def test_citations(spark):
    rows = [("Payers withhold it [2]. A fifth is due [8].", 3, []), ("A fifth is due [9].", 3, []), ("By section 12 each payer withholds a part [1]. Section 7B has another rule for that.", 2, ["12", "13"])]
    df = spark.createDataFrame(rows, "a string, n int, s array<string>")
    got = [r["c"] for r in df.select(t.citation_check(F.col("a"), F.col("n"), None, F.col("s")).alias("c")).collect()]
    assert got[0]["cited"] == [2] and got[0]["invalid"] == [8] and got[0]["text"] == "Payers withhold it [2]. A fifth is due."
    assert got[1]["cited"] == [] and got[1]["text"] == "A fifth is due."
    assert (got[2]["uncited"], got[2]["unsupported"]) == (1, ["7B"])


def test_numbers():
    cases = {
        "Rs. 20 million within twelve days": [12, 20, 20_000_000], "[sixty]million or two [and a half]million": [2.5, 60, 2_500_000, 60_000_000], "one hundred and [ninety-four] shares": [194], "Rs.450,000; nine per cent; 0.7%": [0.7, 9, 450_000], "[hundred] crore": [100, 1_000_000_000],
        "the first of two lakh and five thousand": [1, 2, 200_005, 205_000], "1,50,000 or 0.8%": [0.8, 150_000], "1234,567 and 12.5.7": [12.5, 567, 1234], "twenty first, one million first": [1, 21, 1_000_000], "v2 a1b": [], "": [],
    }
    for text, want in cases.items():
        assert sorted(numbers.numbers_in(text)) == want, text
    assert numbers.numbers_in("one or more of them", skip_lone_one=True) == set()
    assert numbers.numbers_in("by rule 4, sections 7A and 8, item (c) of clause (12) and the Second Schedule, after 6 months", legal=False) == {6}


def test_missing_numbers():
    law, table = "eight percent of what exceeds twenty million", "over Rs.250,000 the rate is 4%"
    assert numbers.missing_numbers("8% over Rs. 20 million (tax year 2026)", law, "", 2026) == []
    assert numbers.missing_numbers("8% over Rs. 20 million (tax year 2025)", law, "", 2026) == [2025]
    assert numbers.missing_numbers("it is 9%", law, "", 2026) == [9]
    for answer in ("4% of what is over Rs. 250,000: 650,000 − 250,000 = 400,000; 4% x 400,000 = Rs. 16,000", "4% over Rs. 250,000. 650,000 − 250,000 = 400,000; 4% x 400,000 = Rs. 16,000."):
        assert numbers.missing_numbers(answer, table, "I earn Rs. 650,000", 2026) == []
    assert numbers.missing_numbers("4% x 400,000 = Rs. 17,000", table, "", 2026) == [17_000, 400_000]


@pytest.mark.parametrize(("text", "value"), [("5% x 200,000", 10_000), ("Rs. 300,000 − 100,000", 200_000), ("(12 + 3) / 5", 3), ("-(2+3)*2%", -0.1), ("2 + 3 x 4", 14), ("8 - 3 - 2", 3), ("__import__('os')", None), ("4 / 0", None), ("(1", None), ("1 2", None), ("", None), ("2 ** 9", None)])
def test_calculations(text, value):
    assert numbers.calculate(text) == (value if value is None else pytest.approx(value))


def test_titles(spark):
    cases = {
        "31. Fees of agents.—(1) Each agent": "Fees of agents", "[6BB. Levy on gains from bonds.— (1) Where": "Levy on gains from bonds", "44K. (1) What an agent files": "",
        "9. Short name. The Act may be called": "Short name", "[[3AC] An extra levy falls on": "", "5 Tax on boats - a levy": "Tax on boats", "8. " + "word " * 40 + "— text": "",
    }
    assert answers(spark, list(cases), chunking.title_of) == list(cases.values())


def test_definitions(spark):
    chunks = spark.createDataFrame([(1, "a", '(45) "private company" means x; [(59AB)] “Small  Company” means a firm defined in section 9'), (2, "b", "(54) [royalty] means any sum\n(55) ‘tax’ includes all; (56) [Royalty] means other; (57) [the thing] is no term")], "ord int, chunk_id string, text string")
    got = {r["term"]: (r["clause"], r["chunk_id"], r["points_to"]) for r in lookup.defined_terms(chunks).collect()}
    assert got == {"private company": ("45", "a", None), "small company": ("59AB", "a", "9"), "royalty": ("54", "b", None), "tax": ("55", "b", None)}
    questions = spark.createDataFrame([(1, "What is a small company?"), (2, "what is the tax rate"), (3, 'What does "royalty" include'), (4, "what is this, and what is tax?"), (5, "company")], "question_id int, text string")
    terms = spark.createDataFrame([(k, v[0]) for k, v in got.items()] + [("company", "1")], "term string, clause string")
    assert {(r["question_id"], r["term"]) for r in lookup.asked_definitions(questions, terms).collect()} == {(1, "small company"), (3, "royalty"), (4, "tax")}
