"""What a title says: role, seniorities and technologies, as native columns compiled from rule tables.

Rules are tried in order and the first that holds decides. Each table is compiled twice: into a Spark column, and into
SQL for the checks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distinct import VALUE, by_value
from .text import any_of, has, literal, quoted, replaced, spelled, sql_has, words_found

# Technologies and the words that name them.
STACKS: dict[str, tuple[str, ...]] = {
    "node.js": ("node.js", "nodejs", "node js", "nestjs", "nest.js", "express.js", "express"),
    "python": ("python", "python3", "django", "fastapi", "flask", "pandas"),
    "golang": ("golang", "go lang"),
    "c": ("c++", "cpp", "cplusplus", "c/c++"),
    "rust": ("rust", "rustlang"),
    "java": ("java", "spring", "spring boot"),
    ".net": (".net", "dotnet", "asp.net", "c#", "csharp"),
    "php": ("php", "laravel", "symfony"),
    "typescript": ("typescript", "type script", "ts"),
    "javascript": ("javascript", "java script", "js"),
    "react": ("react", "reactjs", "react.js"),
    "angular": ("angular", "angularjs"),
    "vue": ("vue", "vuejs", "vue.js"),
    "next.js": ("next.js", "nextjs"),
    "nuxt": ("nuxt", "nuxt.js"),
    "svelte": ("svelte",),
    "react native": ("react native", "react-native"),
    "swift": ("swift",),
    "objc": ("objective-c", "objective c", "objc"),
    "kotlin": ("kotlin",),
    "flutter": ("flutter",),
    "dart": ("dart",),
}
# Technologies by the side of a system they belong to.
BACKEND = ("node.js", "python", "golang", "c", "rust", "java", ".net", "php")
FRONTEND = ("react", "angular", "vue", "next.js", "nuxt", "svelte", "typescript", "javascript")
MOBILE = ("react native", "swift", "objc", "kotlin", "flutter", "dart")
#: Technologies that a role may show; roles that are not listed show all.
ROLE_STACKS: dict[str, tuple[str, ...]] = {"frontend": FRONTEND, "mobile": MOBILE, "fullstack": FRONTEND + BACKEND, "backend": (*BACKEND, "javascript", "typescript")}
STACKLESS_ROLES = ("devops", "qa", "management", "ai", "data", "solutions", "recruiter", "security", "designer")
# Levels, from least to most.
SENIORITIES = ("intern", "junior", "mid", "senior", "staff")


@dataclass(frozen=True)
class Rule:
    """`gives` if every pattern of `all` occurs and none of `none`, after `erase` has been blanked out."""

    gives: str
    all: tuple[str, ...]
    none: tuple[str, ...] = ()
    erase: str | None = None

    def column(self, text: Column) -> Column:
        text = replaced(text, self.erase, " # ") if self.erase else text
        return reduce(lambda a, b: a & b, [has(text, p) for p in self.all] + [~has(text, p) for p in self.none])

    def sql(self, text: str) -> str:
        text = f"regexp_replace({text}, '{quoted(self.erase)}', ' # ', 'g')" if self.erase else text
        return "(" + " AND ".join([sql_has(text, p) for p in self.all] + [f"NOT {sql_has(text, p)}" for p in self.none]) + ")"


HEADS = "(?:head|director|vp) of"
_DESIGNERS = r"(?:design|ux|ui|ux/ui|ui/ux|ux ui|ui ux)"
# The words that decide a role, in order of precedence.
ROLE_RULES: tuple[Rule, ...] = (
    Rule(
        "other",
        (any_of("hrbp", "hr (?:business partner|generalist|specialist|coordinator|manager|director|partner|lead)", "human resources", f"{HEADS} (?:hr|human resources|people)", "chief (?:hr|human resources|people) officer", "chro", "people (?:manager|director|partner|operations|ops|business partner|lead)"),),
        (any_of("engineer", "developer", "architect"),),
    ),
    Rule("management", (any_of("engineering manager", f"{HEADS} (?:engineering|solutions|security)", "tech(?:nical)? lead", "team lead", "staff (?:engineering )?manager", "(?:engineering|security) director", "security manager", "chief information security officer", "ciso"),)),
    Rule("management", (any_of("product (?:marketing )?manager", "product owner", "chief product officer", "(?:head|vp) of product", "product management", "(?:project|program) manager"),)),
    Rule("recruiter", (any_of("recruiter", "talent acquisition", "sourcer", "staffing"),)),
    Rule("solutions", (any_of("(?:solutions?|sales|pre[- ]?sales) (?:engineer|architect|consultant)", "gtm engineer", r"go[-\s]?to[-\s]?market engineer", r"forward[-\s]?deployed (?:[\w/&.-]+ )*engineer", r"forward[-\s]?deployed engineering"),)),
    Rule("designer", (any_of("designer", "(?:ux|user experience) researcher", f"{_DESIGNERS} (?:manager|director|lead)", f"{HEADS} (?:design|ux|ui|product design)", r"(?:ui|ux|ui\s*/\s*ux|ux\s*/\s*ui|ui ux|ux ui) artist"),)),
    Rule("fullstack", (any_of(r"full[\s-]?stack"),)),
    Rule("mobile", (r"\b(?:mobile|ios|android|react native|flutter|swift|kotlin)\b",)),
    Rule("qa", (r"\b(?:qa|quality assurance|test automation|tester|test engineer|sdet|software development engineer in test)\b",)),
    Rule("fullstack", (any_of("winui", "wpf", "maui", "xaml"), r"(?:^|[^a-z0-9])(?:c#|csharp|dotnet|asp\.net|\.net)(?:[^a-z0-9]|$)")),
    Rule("frontend", (any_of(r"front[\s-]?end", "ui", "ux (?:engineer|developer)", "design engineer"),), (any_of(r"back[\s-]?end"),)),
    Rule("backend", (any_of(r"back[\s-]?end", "api", r"server[\s-]?side"),)),
    Rule("devops", (r"\b(?:devops|devsecops|sre|site reliability)\b|\binfrastructure\s+engineer\b|\bplatform\s+(?:software\s+)?engineer\b|\bcloud\s+(?:software\s+)?engineer\b",), erase=r"\bdata\s(?:platform)\b"),
    Rule("engineer", (r"\bpython\s+expert\b|\bexpert\b[^\n]{0,160}\bpython\b|\bpython\b[^\n]{0,160}\bexpert\b",)),
    Rule(
        "security",
        (
            any_of("security", "appsec", r"cyber\s?security", "infosec", "threat", "vulnerability", "soc", "penetration test(?:ing)?", "pentest", "(?:red|blue) team"),
            any_of("engineer", "engineering", "developer", "architect", "pentester", "tester"),
        ),
    ),
    Rule("data", (any_of("(?:decision|marketing|business|growth) (?:data )?scientist"),)),
    Rule(
        "ai",
        (
            r"\b(?:artificial intelligence|machine learning|deep learning|neural|nlp|llm|genai|generative\s+ai|computer vision|ml)\b"
            r"|\bai\s+(?:engineer|engineering|developer|research\s+engineer|data\s+engineer|programmers?|agents?)\b|\b(?:data|applied|research)\s+scientist\b",
        ),
    ),
    Rule("data", (any_of("(?:data|analytics) engineer(?:ing)?", "data platform engineer", "(?:etl|bi) engineer", "(?:data|analytics|insights|reporting|bi|business intelligence) analyst"),)),
    Rule("engineer", (any_of("gameplay programmers?", "(?:software|systems?|application) architect", "member of technical staff", "engineers?", "developpe?r", "engineering"),)),
)

# Words that decide a seniority, in order of precedence; several levels are joined by a comma.
SENIORITY_RULES: tuple[Rule, ...] = (
    Rule("intern", (any_of("intern", "internship"),)),
    Rule("junior", (any_of("junior", "jr", "entry level", "graduate", "trainee", "new grad(?:uate)?", "early career", "apprentice(?:ship)?"),)),
    Rule("mid,senior", (any_of("mid senior"),)),
    Rule("senior,staff", (any_of("senior (?:or )?(?:lead|principal)"),)),
    Rule("staff", (any_of("senior staff", "sr staff", "distinguished", "fellow", "principal", "head", "architect", "manager", "director", "vp", "chief"),)),
    Rule("staff", (r"\blead",), erase=r"\blead\s+(?:the|a|an)\b"),
    Rule("staff", (r"\bstaff\b",), erase=r"\btechnical\sstaff\b"),
    Rule("staff", (r"\bl(?:0?[6-9]|[1-9][0-9])\b",)),
    Rule("senior", (r"\bl0?5\b",)),
    Rule("mid", (r"\bl0?4\b",)),
    Rule("junior", (r"\bl0?[1-3]\b",)),
)
LATE_SENIORITY_RULES: tuple[Rule, ...] = (
    Rule("senior", (any_of("senior", "sr", "snr", "expert", "ssenior"),)),
    Rule("mid", (any_of("mid", "middle", "intermediate"),)),
)
# Titles that a level may follow, and what the level's numbers stand for (places in SENIORITIES).
LEVELLED = ("software engineer", "software development engineer", "software developer", "software engineering", "member of technical staff", "engineer", "developer", "sde", "swe", "mts")
LEVEL_OF: dict[str, int] = {"iv": 5, "4": 5, "5": 5, "iii": 4, "3": 4, "ii": 3, "2": 3, "i": 2, "1": 2}


def _level_pattern() -> str:
    """A title, perhaps the word level, and the numbers behind it. Only the single `i` needs an edge of its own."""
    number = "(?:" + "|".join(w + (r"\b" if w == "i" else "") for w in sorted(LEVEL_OF, key=lambda w: (-len(w), w))) + ")"
    named = "|".join(t.replace(" ", r"\s+") for t in LEVELLED)
    return rf"\b(?:{named})(?:\s+(?:level|lvl))?\s+({number}(?:\s+{number})*)"


LEVELS = _level_pattern()


def first_of(rules: tuple[Rule, ...], text: Column, otherwise: Column) -> Column:
    chain = F.when(rules[0].column(text), F.lit(rules[0].gives))
    for r in rules[1:]:
        chain = chain.when(r.column(text), F.lit(r.gives))
    return chain.otherwise(otherwise)


def sql_first_of(rules: tuple[Rule, ...], text: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {r.sql(text)} THEN '{r.gives}'" for r in rules) + f" ELSE {otherwise} END"


def _around(words: tuple[str, ...]) -> str:
    return "(?:^|[^a-z0-9])(?:" + "|".join(literal(w) for w in words) + ")(?:[^a-z0-9]|$)"


# Words beside which `go` and `c` are, or are not, languages.
GO_WORDS = any_of("golang", "go (?:lang|developer|engineer|backend|programmer)")
ALONE = r"""(?:^|[\s(\[{/,-])%s(?:$|[\s)\]}",/.-])"""
GO_ALONE = Rule("golang", (ALONE % "go",), (r"\bgo[-\s]to[-\s]market\b", r"\bgo\s+live\b"))
C_ALONE = Rule("c", (ALONE % "c",), (r"\bobjective[-\s]?c\b", r"\bc#", r"\bc\s*\+\+", any_of("cpp", "cplusplus")))


def _sql_stack_tests(title: str, more: str) -> dict[str, str]:
    tests = {s: f"({sql_has(title, _around(w))} OR {sql_has(more, _around(w))})" for s, w in STACKS.items()}
    tests["golang"] = f"({tests['golang']} OR {sql_has(title, GO_WORDS)} OR {sql_has(more, GO_WORDS)} OR {GO_ALONE.sql(title)})"
    tests["c"] = f"({tests['c']} OR {C_ALONE.sql(title)})"
    return tests


#: Each word with the technologies it names.
STACK_WORDS: dict[str, tuple[str, ...]] = {w: tuple(s for s, held in STACKS.items() if w in held) for held in STACKS.values() for w in held}


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _in_table_order(names: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, STACKS)), names)


def stacks_named(title: Column, description: Column | None = None) -> Column:
    """All technologies that a title, or its description, names: in the table's order, the title's first."""

    def named(low: Column, *alone: tuple[str, Column]) -> Column:
        found = words_found(low, STACK_WORDS)
        more = [("golang", has(low, GO_WORDS)), *alone]
        return _in_table_order(F.concat(found, F.array_compact(F.array(*[F.when(test, F.lit(s)) for s, test in more]))))

    low = F.regexp_replace(_low(title), "<[^>]*>", " ")
    own = named(low, ("golang", GO_ALONE.column(low)), ("c", C_ALONE.column(low)))
    if description is None:
        return own
    return F.array_union(own, named(F.regexp_replace(_low(description), "<[^>]*>", " ")))


def shown_for(named: Column, role: Column) -> Column:
    """Of the technologies named, those that a posting of this role shows (null or `other`: all)."""
    kept = F.when(role.isin(*STACKLESS_ROLES), F.array().cast("array<string>"))
    for r, allowed in ROLE_STACKS.items():
        kept = kept.when(role == r, F.array_intersect(named, F.array(*map(F.lit, allowed))))
    return kept.otherwise(named)


def stack_of(title: Column, role: Column, description: Column | None = None) -> Column:
    """The technologies a posting shows, by its role."""
    return shown_for(stacks_named(title, description), role)


def role_of(title: Column, named: Column | None = None) -> Column:
    """The role a title names, or `other`; `named`, if it is at hand, is what `stacks_named` gives."""
    low = _low(title)
    named = stacks_named(title) if named is None else named
    of = lambda group: F.arrays_overlap(named, F.array(*map(F.lit, group)))
    by_stack = F.when(of(BACKEND) & of(FRONTEND), F.lit("fullstack")).when(of(BACKEND), F.lit("backend")).when(of(FRONTEND), F.lit("frontend")).when(of(MOBILE), F.lit("mobile")).otherwise(F.lit("engineer"))
    coder = has(low, any_of("developers?", "computer programmers?")) | (has(low, any_of("programmers?")) & (F.size(named) > 0))
    return first_of(ROLE_RULES, low, F.when(coder, by_stack).otherwise(F.lit("other")))


def role_with_description(title: Column, role: Column, description: Column) -> Column:
    """The title's role; full-stack if that is `other`, the title speaks of engineering, and the description of full-stack work."""
    low = _low(title)
    engineering = has(low, any_of("engineers?", "engineering"))
    hr = ROLE_RULES[0].column(low)
    return F.when((role == "other") & engineering & ~hr & has(_low(description), FULL_STACK), F.lit("fullstack")).otherwise(role)


FULL_STACK = any_of(r"full[\s-]?stack")


def read(rows: DataFrame, title: str = "title", values: DataFrame | None = None) -> DataFrame:
    """`rows` with `role` (or `other`), `seniorities` and `technologies`: titles repeat, so each distinct one is read once.

    `values`, if given, holds all titles that may occur.
    """

    def made(values: DataFrame) -> DataFrame:
        own = F.col(VALUE)
        named = values.withColumn("technologies", stacks_named(own))
        return named.select(VALUE, "technologies", role_of(own, F.col("technologies")).alias("role"), seniorities_of(own).alias("seniorities"))

    return by_value(rows, title, made, values)


def sql_stack_lists(title: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{s}' END" for s, t in _sql_stack_tests(title, "''").items()) + "], lambda x: x IS NOT NULL)"


def sql_role_of(title: str) -> str:
    low = f"lower(coalesce({title}, ''))"
    named = sql_stack_lists(low)
    of = lambda group: "list_has_any(" + named + ", [" + ", ".join(f"'{s}'" for s in group) + "])"
    by_stack = f"CASE WHEN {of(BACKEND)} AND {of(FRONTEND)} THEN 'fullstack' WHEN {of(BACKEND)} THEN 'backend' WHEN {of(FRONTEND)} THEN 'frontend' WHEN {of(MOBILE)} THEN 'mobile' ELSE 'engineer' END"
    coder = f"({sql_has(low, any_of('developers?', 'computer programmers?'))} OR ({sql_has(low, any_of('programmers?'))} AND len({named}) > 0))"
    return sql_first_of(ROLE_RULES, low, f"CASE WHEN {coder} THEN {by_stack} ELSE 'other' END")


def _plain(title: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[.,/()_-]+", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def seniorities_of(title: Column) -> Column:
    """The levels a title names, from intern to staff; level suffixes stand for all levels between the least and the most."""
    text = _plain(title)
    tail = F.regexp_extract(text, spelled(LEVELS), 1)
    steps = F.transform(F.split(tail, " "), lambda t: F.coalesce(*[F.when(t == w, F.lit(n)) for w, n in LEVEL_OF.items()]))
    names = F.array(*map(F.lit, SENIORITIES))
    span = F.slice(names, F.array_min(steps), F.array_max(steps) - F.array_min(steps) + 1)
    early = F.split(first_of(SENIORITY_RULES, text, F.lit(None).cast("string")), ",")
    late = F.split(first_of(LATE_SENIORITY_RULES, text, F.lit(None).cast("string")), ",")
    return F.coalesce(early, F.when(tail != "", span), late, F.array().cast("array<string>"))


def sql_seniorities_of(title: str) -> str:
    """Levels joined by commas."""
    text = f"trim(regexp_replace(regexp_replace(lower(coalesce({title}, '')), '[.,/()_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    tail = f"regexp_extract({text}, '{LEVELS}', 1)"
    step = "CASE x " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in LEVEL_OF.items()) + " END"
    steps = f"list_transform(string_split({tail}, ' '), lambda x: {step})"
    span = f"array_to_string([{', '.join(repr(s) for s in SENIORITIES)}][list_min({steps}):list_max({steps})], ',')"
    early = sql_first_of(SENIORITY_RULES, text, "NULL")
    late = sql_first_of(LATE_SENIORITY_RULES, text, "''")
    return f"coalesce({early}, CASE WHEN {tail} <> '' THEN {span} END, {late})"


def title_keyword(title: Column, keyword: str) -> Column:
    """Whether a title holds a keyword: up to four characters without a space only between other characters than letters and digits."""
    word = keyword.strip().lower()
    low = F.lower(F.coalesce(title, F.lit("")))
    if not word:
        return F.lit(False)
    if len(word) <= 4 and " " not in word:
        return low.rlike(f"(^|[^a-z0-9]){literal(word)}([^a-z0-9]|$)")
    return low.contains(word)


def sql_title_keyword(title: str, keyword: str) -> str:
    word = keyword.strip().lower()
    if len(word) <= 4 and " " not in word:
        return sql_has(f"lower({title})", f"(^|[^a-z0-9]){literal(word)}([^a-z0-9]|$)")
    return f"contains(lower(coalesce({title}, '')), '{quoted(word)}')"


# Keywords by which titles without a stored role are found.
ROLE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "backend": ("backend", "back-end", "api", "server", "server-side"),
    "frontend": ("frontend", "front-end", "react", "angular", "vue", "next.js"),
    "fullstack": ("fullstack", "full-stack"),
    "mobile": ("mobile", "android", "ios", "react native", "swift", "kotlin"),
    "devops": ("devops", "devsecops", "sre", "platform engineer", "infrastructure engineer", "cloud engineer", "site reliability"),
    "qa": ("qa", "quality assurance", "test engineer", "automation engineer"),
    "data": ("data engineer", "analytics engineer", "data platform engineer", "etl engineer", "bi engineer", "data analyst", "analytics analyst", "insights analyst", "reporting analyst", "bi analyst", "business intelligence analyst", "decision scientist", "marketing scientist", "business scientist", "growth scientist"),
    "engineer": ("engineer", "engineering", "member of technical staff", "python expert"),
    "ai": ("ai engineer", "ai developer", "ai data engineer", "ai research engineer", "ai/ml engineer", "ai & ml engineer", "ai agents", "artificial intelligence", "machine learning", "deep learning", "ml", "llm", "nlp", "computer vision", "generative ai", "data scientist", "applied scientist", "research scientist"),
    "solutions": ("solutions engineer", "solutions architect", "solutions consultant", "sales engineer", "presales engineer", "gtm engineer", "go-to-market engineer", "forward deployed engineer", "forward deployed enablement engineer"),
    "recruiter": ("recruiter", "talent acquisition", "sourcer", "staffing"),
    "designer": ("designer", "ui/ux design", "ux researcher", "user experience researcher", "ux/ui manager", "ui/ux manager", "ux manager", "ui manager", "design manager", "design director", "design lead", "ux lead", "ui lead", "ux/ui lead", "ui/ux lead", "head of design", "director of design", "vp of design"),
    "security": ("security engineer", "application security", "appsec", "product security", "cloud security", "cybersecurity", "information security", "infosec", "security architect", "offensive security", "defensive security", "penetration testing", "pentest", "soc engineer", "security operations engineer"),
    "management": ("engineering manager", "director of engineering", "head of engineering", "vp of engineering", "tech lead", "technical lead", "team lead", "project manager", "program manager", "product manager", "product marketing manager", "product owner", "head of product", "vp of product", "head of solutions", "director of solutions", "vp of solutions", "head of security", "director of security", "vp of security", "ciso", "chief information security officer", "security manager", "security director"),
}


def bare_title(title: Column) -> Column:
    """A title without a trailing ` - City, XX[, Country]`, else without a closing parenthesis of letters."""
    bare = F.trim(F.regexp_replace(title, r"(?i)\s+-\s+[^,]+,\s*[A-Z]{2}(?:\s*,\s*[A-Za-z][A-Za-z\s]*)?\s*$", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)\s*\(([A-Za-z][A-Za-z\s.'-]{1,60})\)\s*$", ""))


def without_location(title: Column, location: Column, bare: Column | None = None) -> Column:
    """A title without its trailing location: ` - location`, else as `bare_title` has it (`bare`, if at hand)."""
    text = F.trim(F.coalesce(title, F.lit("")))
    place = F.trim(F.coalesce(location, F.lit("")))
    suffix = F.concat(F.lit(" - "), place)
    same = (place != "") & (place != "Unknown") & F.lower(text).endswith(F.lower(suffix))
    cut = F.rtrim(F.substring(text, 1, F.greatest(F.char_length(text) - F.char_length(suffix), F.lit(0))))
    return F.when(same, cut).otherwise(bare_title(text) if bare is None else bare)


def possible_titles(title: Column) -> Column:
    """All that `without_location` may make of a title, whatever its location: an array."""
    text = F.trim(F.coalesce(title, F.lit("")))
    pieces = F.split(text, "(?= - )")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda k: F.rtrim(F.array_join(F.slice(pieces, 1, k), "")))
    return F.concat(F.array(bare_title(text), F.lit("")), heads)


def sql_without_location(title: str, location: str) -> str:
    text, place = f"trim(coalesce({title}, ''))", f"trim(coalesce({location}, ''))"
    bare = rf"trim(regexp_replace({text}, '(?i)\s+-\s+[^,]+,\s*[A-Z]{{2}}(?:\s*,\s*[A-Za-z][A-Za-z\s]*)?\s*$', ''))"
    bare = rf"trim(regexp_replace({bare}, '(?i)\s*\(([A-Za-z][A-Za-z\s.''-]{{1,60}})\)\s*$', ''))"
    return f"CASE WHEN {place} <> '' AND {place} <> 'Unknown' AND ends_with(lower({text}), lower(' - ' || {place})) THEN rtrim(left({text}, length({text}) - length({place}) - 3)) ELSE {bare} END"


def software_intent(title: Column) -> Column:
    """Whether a title asks for a software engineer."""
    return has(F.lower(title), SOFTWARE)


SOFTWARE = any_of("software engineer", "swe", r"(?:full[-\s]?stack|back[-\s]?end|front[-\s]?end) engineer")


def experience_levels(experience: Column) -> Column:
    """Levels from a board's own experience label."""
    low = F.lower(F.trim(F.coalesce(experience, F.lit(""))))
    says = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    middle, senior = says("mid", "intermediate"), says("senior")
    levels = (
        F.when(says("director", "executive", "head", "vp", "chief"), "staff").when(middle & senior, "mid,senior").when(senior, "senior")
        .when(says("entry", "junior", "intern", "trainee"), "junior").when(says("associate") | middle, "mid")
    )
    return F.coalesce(F.split(levels, ","), F.array().cast("array<string>"))
