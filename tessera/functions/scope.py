"""Whether a question is about the law at hand: rules that come before any model, stated as tables of phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.phrases import holds, near_pattern, says, token_line

# Names of the provincial tax on owning property, and of property tax as such.
LEVY = ["urban immovable property tax", "uipt"]
PROPERTY_TAX = ["property tax"]
PROPERTY_TAX_URDU = ["پراپرٹی ٹیکس", "جائیداد ٹیکس"]
# Stems of words for dealing in property, which income tax covers.
DEALING = "sell* sale* sold* bech* bach* buy* bought* purchas* khareed* kharid* transfer* rent* kiray* withholding* 236*".split() + ["capital gain*", "advance tax*"]
DEALING_URDU = "بیچ فروخت خرید منتقل کرای ایڈوانس".split()
# Words for what is to come, and for a budget.
COMING = [
    "next", "upcoming", "coming", "new", "future", "agla", "agle", "aglay", "agley", "nay", "nae", "naye", "naey",
    "ana wala", "ana wale", "ana walay", "ana waley", "ane wala", "ane wale", "ane walay", "ane waley", "anay wala",
    "anay wale", "anay walay", "anay waley", "aney wala", "aney wale", "aney walay", "aney waley", "aana wala",
    "aana wale", "aana walay", "aana waley", "aane wala", "aane wale", "aane walay", "aane waley", "aanay wala",
    "aanay wale", "aanay walay", "aanay waley", "aaney wala", "aaney wale", "aaney walay", "aaney waley",
]
COMING_URDU = ["اگلے", "آنے والے", "نئے"]
BUDGET, BUDGET_URDU = ["budget"], ["بجٹ"]
# Provinces and their revenue authorities; the short names count in capitals only.
AUTHORITY_SHORT = ["SRB", "PRA", "KPRA", "BRA"]
AUTHORITY = [
    "sindh revenue board", "sindh revenue authority", "punjab revenue board", "punjab revenue authority",
    "khyber pakhtunkhwa revenue board", "khyber pakhtunkhwa revenue authority", "balochistan revenue board",
    "balochistan revenue authority",
]
AUTHORITY_URDU = [
    "سندھ ریونیو بورڈ", "سندھ ریونیو اتھارٹی", "پنجاب ریونیو بورڈ", "پنجاب ریونیو اتھارٹی",
    "خیبر پختونخوا ریونیو بورڈ", "خیبر پختونخوا ریونیو اتھارٹی", "بلوچستان ریونیو بورڈ", "بلوچستان ریونیو اتھارٹی",
]
# Sales tax, services and provinces, and income tax.
SALES_TAX, SALES_TAX_URDU = ["sales tax", "salestax"], ["سیلز ٹیکس"]
SERVICES = "service services sindh punjab kp kpk khyber balochistan restaurant*".split()
SERVICES_URDU = "خدمات سروس سندھ پنجاب خیبر بلوچستان ریسٹورنٹ".split()
INCOME_TAX, INCOME_TAX_URDU = ["income tax", "incometax", "withholding", "wht", "151", "153"], ["انکم ٹیکس", "ود ہولڈنگ"]
# Words for being on the list of active taxpayers.
FILER = [
    "filer", "filers", "nonfiler", "nonfilers", "atl", "nonatl", "active taxpayer list", "active taxpayers list",
    "active taxpayer ' s list", "active taxpayers ' list", "active tax payer list", "active tax payers list",
    "active tax payer ' s list", "active tax payers ' list",
]
FILER_URDU = ["فائلر", "ایکٹو ٹیکس"]


def _line(text: Column) -> Column:
    return F.lower(token_line(text))


def provincial_property_tax(text: Column) -> Column:
    """The tax on owning property: by its name, or as plain property tax where nobody deals in the property."""
    line = _line(text)
    plain = says(line, PROPERTY_TAX) | holds(text, PROPERTY_TAX_URDU)
    return says(line, LEVY) | (plain & ~says(line, DEALING) & ~holds(text, DEALING_URDU))


def provincial_sales_tax(text: Column) -> Column:
    """Sales tax on services: by the authority's name, or with a word for services or a province; never with income tax."""
    line = _line(text)
    authority = says(token_line(text), AUTHORITY_SHORT) | says(line, AUTHORITY) | holds(text, AUTHORITY_URDU)
    sales = (says(line, SALES_TAX) | holds(text, SALES_TAX_URDU)) & (says(line, SERVICES) | holds(text, SERVICES_URDU))
    return ~says(line, INCOME_TAX) & ~holds(text, INCOME_TAX_URDU) & (authority | sales)


def future_budget(text: Column) -> Column:
    """A budget that is still to come."""
    line = _line(text)
    return line.rlike(near_pattern(COMING, BUDGET, 2)) | line.rlike(near_pattern(COMING_URDU, BUDGET_URDU, 3))


def filer_question(text: Column) -> Column:
    return says(_line(text), FILER) | holds(text, FILER_URDU)
