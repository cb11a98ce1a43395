"""Values that refer to other values: loops are found first, the rest is replaced in a number of passes that grows with the logarithm of its depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, replaced
from .graph import cut, dependants, strong_components

#: Characters up to which a value may grow; an empty value counts as one.
MAX_CHARS = 1_000_000
#: A value that refers to its own token.
_ITSELF = "contains(value, concat('{{', token, '}}'))"
#: So many values with references are small beside a round's jobs, and are not dealt into layers.
FEW = 100_000
#: A layer takes one in so many of the values that are left, at least.
SHARE = 4


def resolve_values(tokens: DataFrame, env: str = "env", max_chars: int = MAX_CHARS) -> DataFrame:
    """tokens(env, token, value) with nested {{references}} replaced; adds unresolved.

    Values that no other refers to are laid aside, layer by layer, while a layer takes a good part of what is left; once the
    others are done, each layer is replaced in one pass. The strong components of the others' reference graph give the
    circular tokens: these keep their value, and references to them stay where they stand. What is left has no loop, so a pass that replaces every reference by what the other value has
    come to so far halves the depth: a chain of n links takes log2(n) passes, and no value is ever larger than its final
    one. A value that would grow beyond max_chars keeps its text, as do all that need it. unresolved: circular, too long, or
    referring to such a token, over any number of steps. A reference of a token to itself stays; such a
    value goes into no other, so what needs it is unresolved. Undefined names stay, and so do those without a value.
    """
    # odd: braces outside references, with which replacing can make references to any token of the environment
    named = tokens.select(env, "token", "value").distinct().select(F.monotonically_increasing_id().alias("id"), env, "token", "value", _names().alias("names"))
    braces = F.length("value") - F.length(F.replace(F.replace("value", F.lit("{"), F.lit("")), F.lit("}"), F.lit("")))
    odd = F.coalesce(braces - 4 * F.size("names") > 0, F.lit(False))
    given = cut(named.select("id", env, "token", "value", _others(env, F.col("names")).alias("refs"), odd.alias("odd")))
    n, n_odd, n_own, several = given.agg(F.count("*"), F.count_if("odd"), F.count_if(F.expr(_ITSELF)), F.count_if(F.size("refs") > 1)).first()
    replace = lambda rows, values: _replaced_once(rows, values, env, max_chars, several + n_odd > 0)
    open_, columns = given.where("size(refs) > 0").select("id", env, "token", "value", "refs"), [env, "token", "value"]
    inner, layers = _layers(open_, given.where("odd").select(env).distinct() if n_odd else None, env)
    plain, now, halted = given.where("size(refs) = 0").select(columns), inner, []  # halted: circular or too long
    some = not inner.isEmpty()
    stuck = _circular(inner, env) if some else given.select(env, "token").limit(0)
    if some and not stuck.isEmpty():
        now, halted = now.join(stuck, [env, "token"], "left_anti"), [stuck]
    for _ in range(n.bit_length() + 2 if some else 0):  # more passes are asked for only by references that replacing has made
        step = cut(replace(now, plain.unionByName(now.select(columns))))
        moved, long = step.agg(F.count_if("moved"), F.count_if("long")).first()
        if not moved and not long:
            break
        if long:
            halted.append(step.where("long").select(env, "token"))
        now = step.where("NOT long").drop("long", "moved")
    else:
        halted += [step.where("moved").select(env, "token")] if some else []
    done = plain.unionByName(now.select(columns))
    for layer in reversed(layers):
        step = cut(replace(layer, done).select(*columns, "long"))
        if not step.where("long").isEmpty():
            halted.append(step.where("long").select(env, "token"))
        done = done.unionByName(step.where("NOT long").select(columns))
    refs, flagged = given.select(env, "token", F.explode("refs").alias("ref")), []
    if halted:
        halted = cut(reduce(DataFrame.unionByName, halted).distinct())
        too_long = halted.join(stuck, [env, "token"], "left_anti")
        kept = given.join(halted, [env, "token"], "left_semi").select(columns)
        if not too_long.isEmpty():
            kept = kept.unionByName(given.join(_reaching(refs, too_long, env), [env, "token"], "left_semi").select(columns)).distinct()
        done = done.join(kept, [env, "token"], "left_anti").unionByName(kept)
        flagged += [halted, _reaching(refs, halted, env)]
    if n_own:
        flagged.append(_reaching(refs, given.where(_ITSELF).select(env, "token").distinct(), env))
    if not flagged:
        return done.withColumn("unresolved", F.lit(False))
    marks = reduce(DataFrame.unionByName, flagged).distinct().withColumn("unresolved", F.lit(True))
    return done.join(marks, [env, "token"], "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(False)))


def _names() -> Column:
    """All names that a value refers to."""
    return F.regexp_extract_all("value", F.lit(TOKEN), F.lit(1))


def _others(env: str, names: Column) -> Column:
    """Those that are not its own, each once; none without an environment, a token or a value."""
    others = F.array_distinct(F.filter(names, lambda r: r != F.col("token")))
    return F.coalesce(F.when(F.col(env).isNotNull(), others), F.array().cast("array<string>"))


def _layers(rows: DataFrame, odd: DataFrame | None, env: str) -> tuple[DataFrame, list[DataFrame]]:
    """(inner rows, layers): of rows(env, token, refs) those that no other refers to, then those that only these refer to, and so on.

    A layer is read and written with what lies inside it alone, so all layers together cost as much as a few passes over the
    rows. Environments of odd(env) stay whole inside, as any of their tokens may be asked for when values have been replaced.
    """
    whole = None if odd is None else cut(odd)
    rest = rows if whole is None else rows.join(whole, env, "left_anti")
    layers, n = [], rest.count()
    while n > FEW:
        used = rest.select(env, F.explode("refs").alias("token")).distinct().withColumn("used", F.lit(True))
        dealt = cut(rest.join(used, [env, "token"], "left").withColumn("used", F.coalesce("used", F.lit(False))))
        left = dealt.where("used").count()
        if (n - left) * SHARE < n:
            break
        layers.append(dealt.where("NOT used").drop("used"))
        rest, n = dealt.where("used").drop("used"), left
    return (rest if whole is None else rest.unionByName(rows.join(whole, env, "left_semi"))), layers


def _circular(rows: DataFrame, env: str) -> DataFrame:
    """(env, token) of rows(env, token, refs) that are on a loop of references."""
    key = lambda name: F.struct(F.col(env).alias("e"), F.col(name).alias("t"))
    refs = rows.select(env, "token", F.explode("refs").alias("ref"))
    looped = strong_components(refs.select(key("token").alias("node"), key("ref").alias("dep")))
    return cut(looped.select(F.col("node.e").alias(env), F.col("node.t").alias("token")))


def _replaced_once(rows: DataFrame, values: DataFrame, env: str, max_chars: int, several: bool) -> DataFrame:
    """rows(id, env, token, value, refs) with every reference replaced that values(env, token, value) can replace; adds long, moved.

    A value with one name is replaced where it meets the other value; one with several names (if there are) goes along with
    the first of them, and what they stand for is brought together by its id.
    """
    size = F.length(F.regexp_replace("value", TOKEN, "_"))  # a reference counts as one character until it is replaced
    by = values.where(f"value IS NOT NULL AND NOT {_ITSELF}").select(env, F.col("token").alias("ref"), F.col("value").alias("by"), F.greatest(size, F.lit(1)).alias("grows"))
    mark = F.concat(F.lit("{{"), "ref", F.lit("}}"))
    times = ((F.length("value") - F.length(F.replace("value", mark, F.lit("")))) / F.length(mark)).cast("long")
    told = [F.col(c) for c in ("id", env, "token", "value", "refs")]
    pair = F.when(F.col("by").isNotNull(), F.struct(F.col("ref").alias("token"), F.col("by").alias("value")))

    def out(met: DataFrame, new: Column, hit: Column) -> DataFrame:
        long = F.coalesce(size + F.col("more") > max_chars, F.lit(False))
        made = met.withColumn("long", long).withColumn("moved", hit & ~F.col("long")).withColumn("value", F.when(F.col("moved"), new).otherwise(F.col("value")))
        return made.select("id", env, "token", "value", _others(env, _names()).alias("refs"), "long", "moved")

    one = rows.where("size(refs) = 1").withColumn("ref", F.col("refs")[0]).join(by, [env, "ref"], "left")
    parts = [rows.where("size(refs) = 0").select(*told, F.lit(False).alias("long"), F.lit(False).alias("moved")),
             out(one.withColumn("more", times * (F.col("grows") - 1)), F.replace("value", mark, "by"), F.col("by").isNotNull())]
    if several:
        once = F.regexp_count("value", F.lit(TOKEN)) == F.size("refs")
        each = rows.where("size(refs) > 1").withColumn("once", once).select("id", env, "token", "value", "once", F.posexplode("refs").alias("at", "ref"))
        each = each.select("id", env, F.when(F.col("at") == 0, F.struct("token", "value")).alias("row"), "ref", F.when(F.col("once"), 1).otherwise(times).alias("n"))
        met = each.join(by, [env, "ref"], "left").groupBy("id", env).agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list(pair).alias("pairs"), F.sum(F.col("n") * (F.col("grows") - 1)).alias("more"))
        parts.append(out(met.select("id", env, "row.token", "row.value", "pairs", "more"), F.expr(replaced("value", "pairs")), F.size("pairs") > 0))
    return reduce(DataFrame.unionByName, parts)


def _reaching(refs: DataFrame, halted: DataFrame, env: str) -> DataFrame:
    """Tokens whose references lead to a halted one."""
    key = lambda name: F.struct(F.col(env).alias("e"), F.col(name).alias("t"))
    found = dependants(refs.select(key("token").alias("node"), key("ref").alias("dep")), halted.select(key("token").alias("node")))
    return found.select(F.col("node.e").alias(env), F.col("node.t").alias("token"))
