"""Concepts of website sections and the names they go by; spelling is forgiven by length."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import text

# Each concept of a section and the names that mean it, the first concept that has a name counts.
ALIASES = {
    "about": ("about", "about-us", "about us", "who-we-are", "who we are", "who are you", "company", "our story", "our-story", "mission", "story", "team", "our team", "our-team", "leadership", "overview", "founder", "bio", "who are we", "company story", "your story", "learn your story"),
    "contact": ("contact", "contact-us", "contact us", "reach-us", "reach us", "support", "help", "get-in-touch", "get in touch", "locations", "location", "address", "phone", "email", "feedback", "touch"),
    "faq": ("faq", "faqs", "frequently-asked-questions", "frequently asked questions", "frequently asked", "help-center", "help center", "q-and-a", "q&a", "q and a", "questions", "knowledge-base", "questions and answers", "questions & answers", "common questions"),
    "policy": ("policy", "policies", "privacy", "privacy-policy", "privacy policy", "terms", "terms-of-service", "terms of service", "terms-condition", "terms and conditions", "terms-of-use", "terms of use", "legal", "legal-notice", "legal notice", "disclaimer", "cookie-policy", "cookie policy", "refund-policy", "refund policy", "gdpr", "security", "compliance", "our policies", "our policy"),
    "privacy": ("privacy", "privacy-policy", "privacy policy", "gdpr", "data protection", "cookie-policy", "cookie policy"),
    "terms": ("terms", "terms-of-service", "terms of service", "terms-condition", "terms and conditions", "terms-of-use", "terms of use", "legal", "legal-notice", "legal notice", "disclaimer"),
    "courses": ("courses", "course-catalog", "course catalog", "classes", "all-courses", "all courses", "catalog", "catalogue", "programs", "all-programs", "curriculum", "offerings"),
    "catalog": ("catalog", "catalogue", "inventory", "all-vehicles", "vehicles", "shop", "store", "products", "all-products", "services", "all-services", "offerings", "menu", "all courses", "courses", "items"),
    "pricing": ("pricing", "prices", "plans", "costs", "rates", "fees", "tuition", "subscriptions", "membership"),
    "home": ("home", "homepage", "root", "main", "start", "index", "landing", "landing-page", "main-page", "front-page", "website"),
    "blog": ("blog", "news", "articles", "posts", "updates", "press"),
    "careers": ("careers", "jobs", "join-us", "join us", "hiring", "work-with-us", "work with us", "openings"),
    "docs": ("docs", "documentation", "guide", "guides", "manual", "api", "reference"),
}


def plain(x: Column) -> Column:
    """Without diacritics, in lower case; all but ASCII letters and digits are blanks, which collapse."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, text.ACCENTED, text.PLAIN)), "[^a-z0-9]+", " "))


def plain_name(alias: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in alias).split())


def names() -> dict[str, str]:
    """Each name in its plain form and the first concept that has it, in the order of the table."""
    out: dict[str, str] = {}
    for concept, aliases in ALIASES.items():
        for alias in aliases:
            out.setdefault(plain_name(alias), concept)
    return out


def typo(a: Column, b: Column) -> Column:
    """The same but for typing: one edit up to 6 characters (at 4 only behind the same three letters), two beyond; never below 4."""
    la, lb = F.length(a), F.length(b)
    apart, edits, shorter = F.abs(la - lb), F.levenshtein(a, b), F.least(la, lb)
    head = F.startswith(a, F.substring(b, 1, 3)) | F.startswith(b, F.substring(a, 1, 3))
    some = F.when(shorter < 4, F.lit(False)).when(shorter == 4, (apart <= 1) & head & (edits <= 1)).when(F.greatest(la, lb) <= 6, (apart <= 1) & (edits <= 1)).otherwise((apart <= 2) & (edits <= 2))
    return (a == b) | some


def table_of(pairs: Iterable[tuple[str, str]]) -> Column:
    """Structs (name, concept) as one constant; plain names need no quoting."""
    return F.expr("array(" + ", ".join(f"named_struct('name', '{n}', 'concept', '{c}')" for n, c in pairs) + ")")


def concept_of(term: Column) -> Column:
    """The concept of a term: its whole plain form as a name, else the first of its words that is or nearly is one; null without any."""
    known = names()
    named = lambda x: F.element_at(F.expr("map(" + ", ".join(f"'{n}', '{c}'" for n, c in known.items()) + ")"), x)
    table = table_of(known.items())
    # No name has a digit, so a number is not nearly one.
    words = F.filter(F.split(plain(term), " "), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    # The first name in table order for each word (a word of less than four letters is one or none), then the first word that has one.
    hits = F.transform(words, lambda w: F.when(F.length(w) < 4, named(w)).otherwise(F.get(F.filter(table, lambda n: typo(w, n["name"])), F.lit(0))["concept"]))
    return F.coalesce(named(plain(term)), F.get(F.filter(hits, lambda c: c.isNotNull()), F.lit(0)))


def related(a: Column, b: Column) -> Column:
    """Both terms are the same, or mean the same concept, or one is (nearly) a name of the other's concept."""
    pa, pb = plain(a), plain(b)
    table = F.create_map(*(v for c, aliases in ALIASES.items() for v in (F.lit(c), F.array(*(F.lit(plain_name(x)) for x in aliases)))))
    ca, cb = concept_of(a), concept_of(b)
    called = lambda concept, other: F.coalesce(F.exists(F.element_at(table, concept), lambda n: typo(n, other)), F.lit(False))
    alike = (pa == pb) | F.coalesce(ca == cb, F.lit(False)) | called(ca, pb) | called(cb, pa)
    return F.coalesce((pa != "") & (pb != "") & alike, F.lit(False))
