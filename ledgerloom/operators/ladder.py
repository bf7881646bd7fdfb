"""The whole ladder of a movement's category: twenty tiers in order, of which the first that has an answer decides.

Tables that know names (payees, memory, dictionary) are joined once for each distinct name, so a shop that a third of all rows
name is looked up once; accounts are joined on the endings of numbers. What remains is one expression over the row: a
`coalesce` of verdicts, each a struct of category, how sure it is, whether it needs a review, and the kind that it gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ANY_FEE, bank_label, card_fee, looks_like_person, paid_with_card, statement_rows
from ..functions.text import normal_name
from .rules import KEYWORDS, first_match

#: A payee that stands for many: nothing that is known of the name holds.
NO_NAME = "Unknown"
#: Who settles card bills for others, and how cards' bills are named; a payment into one's own account; a person's title or a
#: masked account instead of a name.
BILL_PAYERS = r"(?i)\bcred(?: ?club)?\b|\bdreamplug\b|\bonecard\b|credit ?card|\b(?:card|cc) ?bill\b|bill ?desk.*card"
OWN_FUNDING = r"(?i)^fund\b.*\baccount\b"
TITLED, MASKED = r"(?i)^(?:mr|mrs|ms|miss|dr|shri|sri|smt)\.?\s", r"(?i)^(?:bank account\s+)?[x*]{2,}[0-9]{2,}$"
#: The name of one's own wallet.
WALLET = "UPI Lite"
#: Letters of a dictionary phrase's first word that a name's word must begin with to be held against it.
STEM = 3
TIERS = [
    "row answer", "cashback", "refund", "statement bill", "payee table", "shop credit", "user memory", "card rules", "own account", "own funding", "wallet", "income",
    "card bill", "dictionary", "learned", "bank label", "keywords", "any fee", "person", "unnamed",
]


def in_dictionary(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, phrase, category, place) of the first phrase of `dictionary` (phrase, category, place) found in each distinct `name`.

    A phrase stands in a name as whole words; one that ends in * may end within a word. Names are cut into words once, and
    a word meets the phrases that begin with its first letters through a join: all phrases are looked for in one pass,
    whatever their number. Phrases have three letters at least where they end in *; empty ones match nothing.
    """
    key = lambda word: F.left(word, F.lit(STEM))
    bare = F.trim(F.regexp_replace(F.lower("phrase"), r"\*$", ""))
    phrases = dictionary.select(bare.alias("_phrase"), F.col("phrase").endswith("*").alias("_open"), "phrase", "category", "place").filter("_phrase <> ''")
    phrases = phrases.withColumn("_key", key(F.split_part("_phrase", F.lit(" "), F.lit(1))))
    plain = F.concat(F.lit(" "), F.col("name"), F.lit(" "))
    words = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("_word")).select("name", key(F.col("_word")).alias("_key")).distinct()
    hits = words.join(phrases, "_key").filter(plain.contains(F.concat(F.lit(" "), "_phrase", F.when(F.col("_open"), "").otherwise(" "))))
    return hits.groupBy("name").agg(F.min_by(F.struct("phrase", "category", "place"), F.struct("place", "phrase")).alias("_b")).select("name", "_b.*")


def _ends_in(rows: DataFrame, digits: DataFrame) -> DataFrame:
    """(id) of the rows whose payee's or handle's number ends in one of `digits` (of any lengths: one join for each length)."""
    masked = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9]{2,})[^0-9]*$", 1)
    number = F.coalesce(F.nullif(masked(F.when(F.col("payee").rlike(MASKED), F.col("payee"))), F.lit("")), F.nullif(masked(F.col("payee_handle")), F.lit("")))
    own = digits.select(F.col("digits").alias("_digits")).distinct()
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.length("_number"), F.lit(20)))), lambda n: F.right(F.col("_number"), n))
    each = rows.select("id", number.alias("_number")).filter("_number IS NOT NULL").select("id", F.explode(ends).alias("_digits"))
    return each.join(own, "_digits", "left_semi").select("id").distinct()


def placed(rows: DataFrame, row_answers: DataFrame, payees: DataFrame, memory: DataFrame, own_digits: DataFrame, dictionary: DataFrame, keywords: Sequence[tuple[str, str]] = tuple(KEYWORDS)) -> DataFrame:
    """Movements (id, payee, payee_handle, direction, kind, note, channel, card, paid_from, merchant_category, refs) with tier (from 1,
    null if none has an answer), category, decided_by, confidence and needs_review, and kind as the verdict has it.

    Tables: row_answers (id, category); payees (alias, category, place: the first by place holds that is the name or begins it
    as whole words); memory (name, category, by: user or llm; a user's goes before); own_digits (digits); dictionary
    (phrase, category, place). Where no tier answers, the fallback does: a person that no card paid, else uncategorised,
    both for review. Null texts match nothing; an answer, name or account that is given twice counts once (the first by
    category); each row of `rows` is placed once, ids are distinct; empty tables just know nothing.
    """
    named = rows.select(F.coalesce("payee", F.lit("")).alias("payee")).distinct().withColumn("name", normal_name("payee"))
    # All that names know, once a distinct spelling.
    first_word = F.split_part("name", F.lit(" "), F.lit(1))
    alias = payees.select(normal_name("alias").alias("_alias"), F.col("category").alias("_payee"), "place").filter("_alias <> ''").withColumn("_first", F.split_part("_alias", F.lit(" "), F.lit(1)))
    known = named.withColumn("_first", first_word).join(alias, "_first").filter((F.col("name") == F.col("_alias")) | F.col("name").startswith(F.concat("_alias", F.lit(" "))))
    known = known.groupBy("payee").agg(F.min_by("_payee", F.struct("place", "_payee")).alias("_payee"))
    told = memory.select(normal_name("name").alias("name"), "category", "by").filter("name <> ''")
    told = told.groupBy("name").agg(*[F.min(F.when(F.col("by") == who, F.col("category"))).alias(f"_{who}") for who in ("user", "llm")])
    told = told.withColumn("_llm", F.when(F.col("_user").isNull(), F.col("_llm")))
    shops = in_dictionary(named, dictionary).select("name", F.col("category").alias("_shop"))
    names = named.join(known, "payee", "left").join(told, "name", "left").join(shops, "name", "left").withColumnRenamed("payee", "_name").drop("name")
    answers = row_answers.groupBy("id").agg(F.min("category").alias("_answer"))
    own = _ends_in(rows, own_digits).withColumn("_own", F.lit(True))
    all_ = rows.withColumn("_name", F.coalesce("payee", F.lit(""))).join(names, "_name", "left").join(answers, "id", "left").join(own, "id", "left")

    unnamed = F.col("_name") == NO_NAME
    debit = F.col("direction") == "debit"
    listed = F.size(statement_rows(F.coalesce("refs", F.create_map().cast("map<string,string>")))) > 0
    on_card = paid_with_card() | listed
    text = F.concat_ws(" ", "payee", "note")
    fee = F.when(F.col("kind") == "transfer", "ignored").when(debit, card_fee(text))
    label, keyword = bank_label(F.coalesce("merchant_category", F.lit(""))), first_match(F.lower("_name"), keywords)

    def verdict(when: Column, category: Column | str, by: str, sure: float, review: Column | bool = False, kind: str | None = None) -> Column:
        c = F.lit(category) if isinstance(category, str) else category
        r = F.lit(review) if isinstance(review, bool) else review
        return F.when(when & c.isNotNull(), F.struct(c.alias("category"), F.lit(by).alias("decided_by"), F.lit(sure).alias("confidence"), r.alias("needs_review"), F.lit(kind).cast("string").alias("_kind")))

    is_ = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False))
    yes = F.lit(True)
    tiers = {
        "row answer": verdict(yes, F.col("_answer"), "user", 1.0),
        "cashback": verdict(is_("kind", "cashback"), "income.cashback", "heuristic", 1.0),
        "refund": verdict(is_("kind", "refund"), "income.refund", "heuristic", 0.9),
        "statement bill": verdict(listed & is_("kind", "bill_payment"), "transfers.card_bill", "rule", 0.95),
        "payee table": verdict(~unnamed, F.col("_payee"), "payee", 1.0),
        "shop credit": verdict(is_("direction", "credit") & is_("kind", "income") & F.col("_shop").isNotNull(), "income.refund", "dictionary", 0.9, kind="refund"),
        "user memory": verdict(~unnamed, F.col("_user"), "user", 1.0),
        "card rules": verdict(listed, fee, "rule", 0.95),
        "own account": verdict(F.coalesce("_own", F.lit(False)), "ignored", "self", 0.95, kind="transfer"),
        "own funding": verdict(F.col("_name").rlike(OWN_FUNDING), "ignored", "self", 0.8, True, kind="transfer"),
        "wallet": verdict(is_("kind", "transfer") & (F.col("_name") == WALLET), "ignored", "self", 1.0, kind="transfer"),
        "income": verdict(is_("kind", "income"), "income.received", "heuristic", 0.9),
        "card bill": verdict(F.col("_name").rlike(BILL_PAYERS), "transfers.card_bill", "heuristic", 0.9, kind="bill_payment"),
        "dictionary": verdict(yes, F.col("_shop"), "dictionary", 0.95),
        # A card pays no person, whatever was learnt of the name.
        "learned": verdict(~unnamed & ~(is_("_llm", "transfers.p2p") & on_card), F.col("_llm"), "learned", 0.7, is_("_llm", "transfers.p2p")),
        # A label of the top alone is too coarse to be sure of.
        "bank label": verdict(yes, label, "heuristic", 0.7, ~F.coalesce(label.contains("."), F.lit(False))),
        "keywords": verdict(yes, keyword, "heuristic", 0.75),
        "any fee": verdict(listed & debit & F.lower(text).rlike(ANY_FEE), "fees", "rule", 0.8),
        "person": verdict(~on_card & (F.col("_name").rlike(TITLED) | F.trim("_name").rlike(MASKED)), "transfers.p2p", "heuristic", 0.6, True),
        "unnamed": verdict(unnamed, "uncategorized", "default", 0.0, True),
    }
    ranked = F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("tier"), v.alias("v"))) for i, v in enumerate((tiers[t] for t in TIERS), 1)])
    person = ~on_card & looks_like_person("_name")
    fallback = F.coalesce(verdict(person, "transfers.p2p", "heuristic", 0.4, True), verdict(yes, "uncategorized", "default", 0.0, True))
    out = all_.withColumn("_r", ranked).withColumn("_v", F.coalesce("_r.v", fallback))
    gone = {"category", "decided_by", "confidence", "needs_review", "kind", "tier"}
    kept = [c for c in rows.columns if c not in gone]
    return out.select(*kept, F.coalesce("_v._kind", "kind").alias("kind"), F.col("_r.tier").alias("tier"), *[F.col(f"_v.{c}").alias(c) for c in ("category", "decided_by", "confidence", "needs_review")])


def tier_counts(decided: DataFrame) -> DataFrame:
    """(tier, rows, to_review) of placed()."""
    return decided.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("needs_review"), 1)).alias("to_review"))
