"""User-agent rules as Spark columns.

The rules are data: an ordered list in which the first match wins. ``rule_number`` turns the list
into one ``CASE``; type, version and flags are then looked up by that number, so the triggers are
evaluated once per row.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


# Version extractors. "tail" is the text from the first occurrence of the token, in any case.
def slash_word(token):
    """Second "/"-piece of the tail, cut at the first space."""
    return rf"(?is){token}[^/]*/([^/ ]*)"


def slash_piece(token):
    """Second "/"-piece of the tail, spaces kept."""
    return rf"(?is){token}[^/]*/([^/]*)"


def first_word_slash(token):
    """Second "/"-piece of the tail's first space-separated word."""
    return rf"(?is)^.*?{token}(?:[^ /]*/([^ /]*))?"


def second_word(token):
    """Second space-separated word of the tail."""
    return rf"(?is){token}[^ ]* ([^ ]*)"


@dataclass(frozen=True)
class Rule:
    type: str
    has: tuple = ()  # lower-case tokens that must all occur, in any case
    lacks: tuple = ()  # lower-case tokens that must not occur
    matches: tuple = ()  # regular expressions that must also match the agent as written
    edit: tuple = ()  # (text, replacement) applied to the agent before extraction
    version: str = ""  # regular expression; group 1 is the version
    literal: str | None = None  # the version itself, instead of an expression
    drop: str = ""  # text removed from the extracted version
    mobile: bool = False
    robot: bool = False
    platform: str = ""  # overrides the platform rules


VERSION_TOKEN = r"(?is)version[^/]*/"
NOKIA = r"(?i)Nokia[^/]+/([^ SPsp]+)"
RV = r"(?i)(rv:[0-9].[0-9][a-b]?)"

# Agent tokens, the names they stand for and their order of precedence.
RULES = (
    Rule("WebTV", has=("webtv",), version=slash_word("webtv")),
    Rule(
        "Internet Explorer",
        has=("microsoft internet explorer",),
        matches=(r"(?is)/.*(308|425|426|474|0b1)",),
        literal="1.5",
    ),
    Rule("Internet Explorer", has=("microsoft internet explorer",), literal="1.0"),
    Rule("MSN Browser", has=("msie", "msnb"), lacks=("opera",), version=second_word("msn"), edit=(";", "; ")),
    Rule("Internet Explorer", has=("msie",), lacks=("opera",), version=second_word("msie"), edit=(";", "; ")),
    Rule(
        "Pocket Internet Explorer",
        has=("mspie",),
        version=second_word("mspie"),
        mobile=True,
        platform="Windows CE",
    ),
    Rule(
        "Pocket Internet Explorer",
        has=("pocket",),
        version=r"(?s)^[^/]*/([^/]*)",
        mobile=True,
        platform="Windows CE",
    ),
    Rule(
        "Opera Mini",
        has=("opera mini",),
        matches=(r"(?is)opera mini.*/",),
        version=slash_word("opera mini"),
        mobile=True,
    ),
    Rule("Opera Mini", has=("opera mini",), version=r"(?i)opera (mini[^ ]*)", mobile=True),
    Rule(
        "Opera",
        has=("opera", "version/10"),
        matches=(r"(?is:opera.*)Version/10.*$",),
        version=r"(?is:opera.*?)Version/(10.*)$",
    ),
    Rule("Opera", has=("opera",), matches=(r"(?is)opera.*/",), edit=("(", " "), version=slash_word("opera")),
    Rule("Opera", has=("opera",), version=second_word("opera")),
    Rule("Galeon", has=("galeon",), version=first_word_slash("galeon")),
    Rule("Netscape Navigator", has=("firefox", "navigator/"), version=r"(?i)Navigator/([^ ]*)"),
    Rule(
        "Netscape Navigator",
        has=("netscape",),
        lacks=("firefox",),
        matches=(r"(?i)Netscape6?/",),
        version=r"(?i)Netscape6?/([^ ]*)",
    ),
    Rule(
        "Firefox",
        has=("firefox",),
        lacks=("safari",),
        matches=(r"(?i)Firefox[/ (][^ ;)]",),
        version=r"(?i)Firefox[/ (]([^ ;)]+)",
    ),
    Rule("Firefox", has=("firefox",), lacks=("safari",), matches=(r"(?i)Firefox$",), literal=""),
    Rule("Chrome", has=("chrome",), version=slash_word("chrome")),
    Rule("OmniWeb", has=("omniweb",), version=slash_word("omniweb")),
    Rule(
        "Android",
        has=("android",),
        matches=(r"(?is)android[^ ]* ",),
        version=second_word("android"),
        mobile=True,
    ),
    Rule("Android", has=("android",), literal=UNKNOWN, mobile=True),
    Rule("iPad", has=("ipad",), matches=(VERSION_TOKEN,), version=slash_word("version"), mobile=True),
    Rule("iPad", has=("ipad",), literal=UNKNOWN, mobile=True),
    Rule("iPod", has=("ipod",), matches=(VERSION_TOKEN,), version=slash_word("version"), mobile=True),
    Rule("iPod", has=("ipod",), literal=UNKNOWN, mobile=True),
    Rule("iPhone", has=("iphone",), matches=(VERSION_TOKEN,), version=slash_word("version"), mobile=True),
    Rule("iPhone", has=("iphone",), literal=UNKNOWN, mobile=True),
    Rule("BlackBerry", has=("blackberry",), version=slash_word("blackberry"), mobile=True),
    Rule(
        "Nokia S60 OSS Browser",
        has=("nokia",),
        matches=(NOKIA, r"(?i:series60)|S60"),
        version=NOKIA,
        mobile=True,
    ),
    Rule("Nokia Browser", has=("nokia",), matches=(NOKIA,), version=NOKIA, mobile=True),
    Rule("GoogleBot", has=("googlebot",), version=slash_word("googlebot"), robot=True),
    Rule("MSN Bot", has=("msnbot",), version=slash_word("msnbot"), robot=True),
    Rule("Yahoo! Slurp", has=("slurp",), version=slash_word("slurp"), robot=True),
    # An agent with "iphone" or "ipod" never gets this far.
    Rule("Safari", has=("safari",), matches=(VERSION_TOKEN,), version=slash_word("version")),
    Rule("Safari", has=("safari",), literal=UNKNOWN),
    Rule("NetPositive", has=("netpositive",), version=slash_word("netpositive")),
    Rule("Firebird", has=("firebird",), version=slash_piece("firebird")),
    Rule("Konqueror", has=("konqueror",), version=first_word_slash("konqueror")),
    Rule("iCab", has=("icab",), edit=("/", " "), version=second_word("icab")),
    Rule("Phoenix", has=("phoenix",), version=slash_piece("phoenix")),
    Rule("Amaya", has=("amaya",), version=slash_word("amaya")),
    Rule("Lynx", has=("lynx",), version=slash_word("lynx")),
    Rule("Shiretoko", has=("mozilla", "shiretoko/"), version=r"(?i)Shiretoko/([^ ]*)"),
    Rule("IceCat", has=("mozilla", "icecat/"), version=r"(?i)IceCat/([^ ]*)"),
    Rule("W3C Validator", has=("w3c-checklink",), version=slash_word("w3c-checklink")),
    Rule(
        "W3C Validator",
        has=("w3c_validator",),
        edit=("W3C_Validator ", "W3C_Validator/"),
        version=slash_word("w3c_validator"),
    ),
    Rule("Mozilla", has=("mozilla", "rv:"), lacks=("netscape",), matches=(RV,), version=RV, drop="rv:"),
    Rule("Mozilla", has=("mozilla/",), lacks=("netscape",), version=r"(?i)mozilla/([^ ]*)"),
)

# Fixed values: (token, platform), first match wins. The backslash belongs to the OS/2 token.
PLATFORMS = (
    ("windows", "Windows"),
    ("ipad", "iPad"),
    ("ipod", "iPod"),
    ("iphone", "iPhone"),
    ("mac", "Apple"),
    ("android", "Android"),
    ("linux", "Linux"),
    ("nokia", "Nokia"),
    ("blackberry", "BlackBerry"),
    ("freebsd", "FreeBSD"),
    ("openbsd", "OpenBSD"),
    ("netbsd", "NetBSD"),
    ("opensolaris", "OpenSolaris"),
    ("sunos", "SunOS"),
    ("os\\/2", "OS/2"),
    ("beos", "BeOS"),
    ("win", "Windows"),
)


def rule_number(agent: Column, low: Column) -> Column:
    """Index of the first rule that fires, ``len(RULES)`` if none. ``low`` is ``lower(agent)``."""
    chain = F
    for number, rule in enumerate(RULES):
        chain = chain.when(_fires(rule, agent, low), F.lit(number))
    return chain.otherwise(F.lit(len(RULES)))


def _fires(rule, agent, low):
    tests = [low.contains(token) for token in rule.has]
    tests += [~low.contains(token) for token in rule.lacks]
    tests += [agent.rlike(pattern) for pattern in rule.matches]
    fires = tests[0]
    for test in tests[1:]:
        fires = fires & test
    return fires


def browser_type(number: Column) -> Column:
    return F.get(F.array(*[F.lit(rule.type) for rule in RULES], F.lit(UNKNOWN)), number)


def browser_version(number: Column, agent: Column) -> Column:
    chain = F
    for index, rule in enumerate(RULES):
        if rule.literal is None:
            chain = chain.when(number == index, _extract(rule, agent))
    literals = {rule.literal for rule in RULES if rule.literal is not None}
    for text in sorted(literals - {UNKNOWN}):
        hits = [i for i, rule in enumerate(RULES) if rule.literal == text]
        chain = chain.when(number.isin(hits), F.lit(text))
    return F.regexp_replace(chain.otherwise(F.lit(UNKNOWN)), "[^0-9,.a-zA-Z-]", "")


def _extract(rule, agent):
    if rule.edit:
        agent = F.replace(agent, F.lit(rule.edit[0]), F.lit(rule.edit[1]))
    version = F.regexp_extract(agent, rule.version, 1)
    return F.replace(version, F.lit(rule.drop), F.lit("")) if rule.drop else version


def platform(number: Column, low: Column) -> Column:
    overrides = {rule.platform for rule in RULES if rule.platform}
    chain = F
    for name in sorted(overrides):
        hits = [i for i, rule in enumerate(RULES) if rule.platform == name]
        chain = chain.when(number.isin(hits), F.lit(name))
    for token, name in PLATFORMS:
        chain = chain.when(low.contains(token), F.lit(name))
    return chain.otherwise(F.lit(UNKNOWN))


def is_mobile(number: Column) -> Column:
    return number.isin([i for i, rule in enumerate(RULES) if rule.mobile])


def is_robot(number: Column) -> Column:
    return number.isin([i for i, rule in enumerate(RULES) if rule.robot])


def is_aol(low: Column) -> Column:
    return low.contains("aol")


def aol_version(agent: Column, low: Column) -> Column:
    version = F.regexp_extract(agent, second_word("aol"), 1)
    return F.when(is_aol(low), F.regexp_replace(version, "[^0-9.a-zA-Z]", "")).otherwise(F.lit(UNKNOWN))


def is_chromeframe(agent: Column) -> Column:
    return agent.contains("chromeframe")


def is_browser(type_column: Column, name: str) -> Column:
    """Whether the browser has this name, ignoring case and surrounding blanks."""
    return F.lower(type_column) == F.lower(F.trim(F.lit(name)))
