"""Weighted pattern rules, their hits and verdicts.

A rule's pattern is a literal, so one scan of the text runs all rules and no rule table is
joined. Patterns run on canonical (lower-case) text and keep to what both RE2 and Java take.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import canonical, contains_any


class Rule(NamedTuple):
    rule_id: str
    family: str
    pattern: str
    weight: float
    #: Any text that the pattern matches has one of these; none: unknown.
    needs: tuple[str, ...] = ()


#: Prompt-injection rules.
INJECTION = (
    Rule("ignore_previous", "override", "(ignore|disregard|forget|override) (all |any |the |your )*(previous|prior|above|earlier|preceding) (instructions|instruction|prompts|prompt|rules|messages|directions)", 1.0, ("ignore ", "disregard ", "forget ", "override ")),
    Rule("new_instructions", "override", "(new|updated|real) (system )?(instructions|instruction|rules) *(:|are|follow)", 0.6, ("instruction", "rules")),
    Rule("reveal_prompt", "exfiltration", "(reveal|print|show|repeat|output|leak) (me )?(all |the |your )*(hidden |secret |initial )*(system prompt|instructions|system message|initial prompt)", 0.9, ("system prompt", "instructions", "system message", "initial prompt")),
    Rule("send_secrets", "exfiltration", "(send|post|email|upload|forward) (me )?(all |the |your |any )*(password|passwords|api key|api keys|credentials|secrets|tokens)", 0.8, ("password", "api key", "credentials", "secrets", "tokens")),
    Rule("persona", "jailbreak", "(you are now|act as|pretend to be|roleplay as) (a |an |the )*(dan|unrestricted|jailbroken|evil|developer mode|unfiltered)", 0.8, ("you are now ", "act as ", "pretend to be ", "roleplay as ")),
    Rule("no_limits", "jailbreak", "(without|no) (any )?(restrictions|filters|limits|safety|guardrails|censorship)", 0.4, ("restrictions", "filters", "limits", "safety", "guardrails", "censorship")),
    Rule("role_marker", "spoofing", "(<\\|im_start\\|>|<\\|system\\|>|\\[inst\\]|<<sys>>|### *(system|instruction|assistant) *:|(^|[ >])(system|assistant) *: )", 0.7, ("<|im_start|>", "<|system|>", "[inst]", "<<sys>>", "###", "system", "assistant")),
)
#: Abuse lexicon, judged against the `toxic` label as a stand-in.
ABUSE = (Rule("abuse", "abuse", "(^|[^a-z])(idiot|moron|clown|worthless)([^a-z]|$)", 1.0, ("idiot", "moron", "clown", "worthless")),)


def with_hits(df: DataFrame, text: str, rules: Sequence[Rule] = INJECTION, name: str = "hits") -> DataFrame:
    """df with an array of (rule_id, family, n, weight) for the rules that hit.

    A rule's pattern runs only on texts that have one of the strings it needs, which few have.
    """
    clean = canonical(F.coalesce(F.col(text), F.lit("")))

    def count(low: Column, r: Rule) -> Column:
        n = F.regexp_count(low, F.lit(r.pattern))
        return F.when(contains_any(low, r.needs), n).otherwise(0) if r.needs else n

    def hit(low: Column) -> Column:
        found = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.family).alias("family"), count(low, r).alias("n"), F.lit(r.weight).alias("weight")) for r in rules]
        return F.filter(F.array(*found), lambda h: h["n"] > 0)

    return df.withColumn(name, F.transform(F.array(clean), hit)[0])


def exploded(df: DataFrame, keep: Sequence[str], name: str = "hits") -> DataFrame:
    """One row per unit and rule that hit."""
    return df.select(*keep, F.inline(name))


def score(name: str = "hits") -> Column:
    """Sum of the weights of the rules that hit, each once."""
    return F.aggregate(name, F.lit(0.0), lambda a, h: a + h["weight"])


def verdicts(df: DataFrame, key: Sequence[str], threshold: float = 0.7, name: str = "hits") -> DataFrame:
    """Per key: score over all rows' hits, flag and sorted families."""
    grouped = df.groupBy(*key).agg(F.round(F.sum(score(name)), 6).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(name, lambda h: h["family"]))))).alias("families"))
    return grouped.select(*key, "score", (F.col("score") >= threshold).alias("flagged"), F.array_join("families", ",").alias("families"))
