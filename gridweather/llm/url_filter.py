"""URL filter: empirical-Bayes reputation of hosts below fixed rules.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level's rate is shrunk towards its
parent's by a beta-binomial prior whose weight comes from the spread between the groups of that level; a host is blocked when
the lower bound of its posterior passes a threshold. A host without labelled pages has its domain's posterior, that without
any its suffix's. The registered domain is the label before the suffix and the suffix; suffixes of several labels are a parameter.
Ports and user names are no part of it, and an address is its own domain and suffix.

Null url, or no ``://``: host and path are empty, no rule fits, and the verdict is that of the whole corpus. Null page ids stay.
Repeated outcomes of one page count once, as bad if any of them is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import ascii_lower, written

# Fixed values: (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Public suffixes of two labels under which names are registered; all others have one label.
SUFFIXES = (
    "ac.at co.at or.at com.au net.au org.au edu.au gov.au com.br net.br org.br gov.br com.cn net.cn org.cn edu.cn gov.cn com.hk org.hk com.mx org.mx gob.mx "
    "co.id ac.id or.id co.il ac.il org.il co.in net.in org.in ac.in gov.in co.jp ne.jp or.jp ac.jp go.jp co.ke or.ke co.kr or.kr ac.kr go.kr com.my org.my "
    "co.nz net.nz org.nz ac.nz govt.nz com.pl org.pl edu.pl com.sg edu.sg gov.sg co.th ac.th com.tr org.tr edu.tr gov.tr com.tw org.tw edu.tw "
    "com.ua org.ua co.uk org.uk me.uk ltd.uk plc.uk net.uk sch.uk ac.uk gov.uk nhs.uk co.za org.za ac.za gov.za"
).split()
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Reputation:
    """Block where ``mean - z * sd`` of the posterior is over ``threshold``; priors weigh between the two ``strength`` bounds."""

    threshold: float = 0.5
    z: float = 1.645
    strength: tuple[float, float] = (2.0, 200.0)
    suffixes: tuple[str, ...] = tuple(SUFFIXES)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, rule in sorted(rules, key=lambda x: len(x[1])):  # later ones, being longer, win
        name, tail = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return found, verdict


def parts_of(host: Column, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> dict[str, Column]:
    """Host, registered domain and suffix."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    address = name.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return {"host": host, "domain": domain, "suffix": F.when(address, name).when(long, two).otherwise(F.substring_index(name, ".", -1))}


def reputations(outcomes: DataFrame, how: Reputation = Reputation()) -> dict[str, DataFrame]:
    """From ``outcomes`` (host, bad) a table per level: the name and its posterior ``a``, ``b``; ``all`` has one row."""
    base = outcomes.select(F.col("host").alias("_h"), F.col("bad").cast("int").alias("_bad"))
    counts = base.groupBy("_h").agg(F.count("_bad").alias("n"), F.sum("_bad").alias("k"))
    counts = counts.select(*[c.alias(name) for name, c in parts_of(F.col("_h"), how.suffixes).items()], "n", "k")
    # Every level starts from these counts, and every search from the levels' tables: each is written once.
    counts = written(outcomes.sparkSession, counts, "host-counts")
    sums = {level: counts.groupBy(*LEVELS[: i + 1]).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) for i, level in enumerate(LEVELS)}
    top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    # Six numbers come back: for each level how far its groups spread around the rate of all.
    rate = top.select(((F.col("k") + 0.5) / (F.col("n") + 1)).alias("p")).first()["p"]
    weight = {}
    for level, table in sums.items():
        row = table.where("n > 1").agg(
            F.count("n").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("k") / F.col("n") - rate) ** 2).alias("ss"), F.sum("n").alias("w")
        ).first()
        weight[level] = _strength(row, rate, how.strength)
    out = {"all": top.select((F.lit(rate) * how.strength[0] + F.col("k")).alias("a"), (F.lit(1 - rate) * how.strength[0] + F.col("n") - F.col("k")).alias("b"))}
    above = None
    for i, level in enumerate(LEVELS):
        mean = F.lit(rate) if above is None else F.col("_a") / (F.col("_a") + F.col("_b"))
        table = sums[level] if above is None else sums[level].join(above, list(LEVELS[:i]))
        s = weight[level]
        made = table.select(*LEVELS[: i + 1], (mean * s + F.col("k")).alias("a"), ((1 - mean) * s + F.col("n") - F.col("k")).alias("b"))
        made = written(outcomes.sparkSession, made, f"{level}-posteriors")
        out[level] = made.select(level, "a", "b")
        above = made.select(*LEVELS[: i + 1], F.col("a").alias("_a"), F.col("b").alias("_b"))
    return out


def _strength(row, rate: float, bounds: tuple[float, float]) -> float:
    """Prior weight by moments: the spread between groups beyond what chance gives."""
    if not row["groups"] or row["groups"] < 2:
        return bounds[1]
    chance, seen = rate * (1 - rate), row["ss"] / row["w"]
    expected = chance * row["groups"] / row["w"]
    extra = seen - expected
    if extra <= 0:
        return bounds[1]
    return float(min(bounds[1], max(bounds[0], chance / extra - 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, how: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the posterior mean ``badness`` of the level that spoke."""
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "_said": said, **{f"_{k}": c for k, c in parts_of(F.col("host"), how.suffixes).items()}})
    tables = reputations(outcomes, how)
    # Distinct hosts are judged once; the pages then meet one row per host in a join that Spark may split.
    hosts = base.select("_host", "_domain", "_suffix").distinct()
    for level in LEVELS:
        named = tables[level].select(F.col(level).alias(f"_{level}"), F.struct("a", "b").alias(f"_p_{level}"))
        hosts = hosts.join(named, f"_{level}", "left")
    everywhere = tables["all"].select(F.struct("a", "b").alias("p")).first()["p"]
    post = F.coalesce(*[F.col(f"_p_{level}") for level in reversed(LEVELS)], F.struct(F.lit(float(everywhere["a"])).alias("a"), F.lit(float(everywhere["b"])).alias("b")))
    hosts = hosts.select("_host", post.alias("_post"))
    a, b = F.col("_post.a"), F.col("_post.b")
    mean = a / (a + b)
    low = mean - how.z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    learned = F.when(low > how.threshold, "block").otherwise("allow")
    return base.join(hosts, "_host").select("page_id", "host", "path", "rule", F.coalesce("_said", learned).alias("verdict"), mean.alias("badness"))
