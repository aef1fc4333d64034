"""Locations: raw text to display form, segments, and facets (tokens, countries, regions).

Facets are made over the distinct strings of a table: segments are exploded, looked up in a gazetteer (a broadcast table
of terms, whose size is fixed), and gathered again by string. The gazetteer is a parameter: `gazetteer()` builds a small
default from ISO names, postal codes and a few cities; pass a table of your own for more cities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.tables import stored

from .phrases import Rule, rewriter, sql_rewrite
from .text import EDGE, any_of, has, literal, quoted, replaced, sql_literal, trimmed, words_found

# Names of regions as written, and as stored.
REGIONS: dict[str, str] = {
    "apac": "apac", "emea": "emea", "latam": "latin america", "latin america": "latin america", "noram": "north america", "namer": "north america",
    "nordics": "nordics", "iberia": "iberia", "dach": "dach", "mena": "mena", "amer": "americas", "americas": "americas", "north america": "north america",
    "south america": "south america", "asia": "asia", "europe": "europe", "eu": "european union", "european union": "european union", "africa": "africa",
    "east coast": "east coast", "west coast": "west coast", "global": "global", "worldwide": "worldwide", "central america": "central america",
    "middle east": "middle east", "central asia": "central asia", "east asia": "east asia", "southeast asia": "southeast asia", "cis": "cis",
    "us east coast": "east coast", "us west coast": "west coast",
}
# Other names of countries.
COUNTRY_NAMES: dict[str, str] = {
    "usa": "united states", "us": "united states", "u s": "united states", "u s a": "united states", "united states of america": "united states", "can": "canada",
    "uk": "united kingdom", "england": "united kingdom", "scotland": "united kingdom", "great britain": "united kingdom", "uae": "united arab emirates",
    "czech republic": "czechia", "viet nam": "vietnam", "republic of korea": "south korea", "korea": "south korea", "russian federation": "russia",
    "türkiye": "turkey", "brasil": "brazil", "méxico": "mexico", "deutschland": "germany", "ch": "switzerland", "ind": "india", "irl": "ireland",
    "u.s.a": "united states", "u.s": "united states", "cze": "czechia", "people's republic of china": "china", "people’s republic of china": "china", "syrian arab republic": "syria",
    "bosnia": "bosnia & herzegovina", "bosnia and herzegovina": "bosnia & herzegovina", "macedonia": "north macedonia", "republic of north macedonia": "north macedonia",
    "lao people's democratic republic": "laos", "lao people’s democratic republic": "laos", "lao pdr": "laos", "singapoor": "singapore", "philipines": "philippines",
    "phillipines": "philippines", "ivory coast": "côte d’ivoire", "cote d'ivoire": "côte d’ivoire", "côte d'ivoire": "côte d’ivoire", "cayman": "cayman islands",
    "congo brazzaville": "congo - brazzaville", "republic of the congo": "congo - brazzaville", "democratic republic of congo": "congo - kinshasa", "costa rice": "costa rica",
    "united state": "united states", "unites states": "united states",
}
COUNTRIES = (
    "argentina armenia australia austria bangladesh belgium brazil bulgaria canada chile china colombia croatia cyprus czechia denmark egypt estonia "
    "finland france georgia germany ghana greece hungary iceland india indonesia ireland israel italy japan jordan kazakhstan kenya latvia lithuania "
    "luxembourg malaysia malta mexico moldova morocco netherlands nigeria norway pakistan panama peru philippines poland portugal qatar romania russia "
    "serbia singapore slovakia slovenia spain sweden switzerland taiwan thailand tunisia turkey ukraine uruguay vietnam"
).split() + ["united states", "united kingdom", "united arab emirates", "south korea", "south africa", "new zealand", "saudi arabia", "costa rica", "sri lanka", "hong kong"] + (
    "dominican republic,azerbaijan,nepal,ecuador,paraguay,el salvador,honduras,nicaragua,guatemala,bolivia,venezuela,jamaica,albania,andorra,libya,syria,rwanda,namibia,uganda,"
    "belarus,cambodia,bosnia & herzegovina,bermuda,north macedonia,ethiopia,montenegro,papua new guinea,uzbekistan,kyrgyzstan,turkmenistan,lebanon,laos,puerto rico,gibraltar,"
    "côte d’ivoire,senegal,cameroon,mali,benin,congo - brazzaville,congo - kinshasa,algeria,mauritius,brunei,oman,mongolia,madagascar,san marino,haiti,kuwait,kosovo,seychelles,"
    "cayman islands"
).split(",")
ISO2: dict[str, str] = {
    "ae": "united arab emirates", "ar": "argentina", "at": "austria", "au": "australia", "be": "belgium", "br": "brazil", "ca": "canada", "ch": "switzerland", "cl": "chile",
    "co": "colombia", "cz": "czechia", "de": "germany", "dk": "denmark", "ee": "estonia", "es": "spain", "fi": "finland", "fr": "france", "gb": "united kingdom", "gr": "greece",
    "hu": "hungary", "ie": "ireland", "il": "israel", "in": "india", "it": "italy", "jp": "japan", "kr": "south korea", "lt": "lithuania", "mx": "mexico", "nl": "netherlands",
    "no": "norway", "nz": "new zealand", "ph": "philippines", "pl": "poland", "pt": "portugal", "ro": "romania", "rs": "serbia", "se": "sweden", "sg": "singapore", "tr": "turkey",
    "ua": "ukraine", "us": "united states", "vn": "vietnam", "za": "south africa",
    "ad": "andorra", "al": "albania", "am": "armenia", "az": "azerbaijan", "ba": "bosnia & herzegovina", "bd": "bangladesh", "bg": "bulgaria", "bj": "benin", "bm": "bermuda",
    "bn": "brunei", "bo": "bolivia", "by": "belarus", "cd": "congo - kinshasa", "cg": "congo - brazzaville", "ci": "côte d’ivoire", "cm": "cameroon", "cn": "china", "cr": "costa rica",
    "cy": "cyprus", "do": "dominican republic", "dz": "algeria", "ec": "ecuador", "eg": "egypt", "et": "ethiopia", "ge": "georgia", "gh": "ghana", "gi": "gibraltar",
    "gt": "guatemala", "hn": "honduras", "hr": "croatia", "ht": "haiti", "id": "indonesia", "is": "iceland", "jm": "jamaica", "jo": "jordan", "ke": "kenya",
    "kg": "kyrgyzstan", "kh": "cambodia", "kw": "kuwait", "ky": "cayman islands", "kz": "kazakhstan", "la": "laos", "lb": "lebanon", "lk": "sri lanka", "lu": "luxembourg",
    "lv": "latvia", "ly": "libya", "ma": "morocco", "md": "moldova", "me": "montenegro", "mg": "madagascar", "mk": "north macedonia", "ml": "mali", "mn": "mongolia",
    "mt": "malta", "mu": "mauritius", "my": "malaysia", "na": "namibia", "ng": "nigeria", "ni": "nicaragua", "np": "nepal", "om": "oman", "pa": "panama",
    "pe": "peru", "pg": "papua new guinea", "pk": "pakistan", "pr": "puerto rico", "py": "paraguay", "qa": "qatar", "ru": "russia", "rw": "rwanda", "sa": "saudi arabia",
    "sc": "seychelles", "si": "slovenia", "sk": "slovakia", "sm": "san marino", "sn": "senegal", "sv": "el salvador", "sy": "syria", "th": "thailand", "tm": "turkmenistan",
    "tn": "tunisia", "tw": "taiwan", "ug": "uganda", "uy": "uruguay", "uz": "uzbekistan", "ve": "venezuela", "xk": "kosovo",
}
# The rest of ISO 3166, as shown in English. They are no known countries, so hints keep these codes; previews ask for them.
OTHER_ISO2: dict[str, str] = {
    "af": "afghanistan", "ag": "antigua & barbuda", "ai": "anguilla", "ao": "angola", "aq": "antarctica", "as": "american samoa", "aw": "aruba", "ax": "åland islands", "bb": "barbados",
    "bf": "burkina faso", "bh": "bahrain", "bi": "burundi", "bl": "st. barthélemy", "bq": "caribbean netherlands", "bs": "bahamas", "bt": "bhutan", "bv": "bouvet island", "bw": "botswana",
    "bz": "belize", "cc": "cocos (keeling) islands", "cf": "central african republic", "ck": "cook islands", "cu": "cuba", "cv": "cape verde", "cw": "curaçao", "cx": "christmas island", "dj": "djibouti",
    "dm": "dominica", "eh": "western sahara", "er": "eritrea", "fj": "fiji", "fk": "falkland islands", "fm": "micronesia", "fo": "faroe islands", "ga": "gabon", "gd": "grenada",
    "gf": "french guiana", "gg": "guernsey", "gl": "greenland", "gm": "gambia", "gn": "guinea", "gp": "guadeloupe", "gq": "equatorial guinea", "gs": "south georgia & south sandwich islands", "gu": "guam",
    "gw": "guinea-bissau", "gy": "guyana", "hk": "hong kong sar china", "hm": "heard & mcdonald islands", "im": "isle of man", "io": "british indian ocean territory", "iq": "iraq", "ir": "iran", "je": "jersey",
    "ki": "kiribati", "km": "comoros", "kn": "st. kitts & nevis", "kp": "north korea", "lc": "st. lucia", "li": "liechtenstein", "lr": "liberia", "ls": "lesotho", "mc": "monaco",
    "mf": "st. martin", "mh": "marshall islands", "mm": "myanmar (burma)", "mo": "macao sar china", "mp": "northern mariana islands", "mq": "martinique", "mr": "mauritania", "ms": "montserrat", "mv": "maldives",
    "mw": "malawi", "mz": "mozambique", "nc": "new caledonia", "ne": "niger", "nf": "norfolk island", "nr": "nauru", "nu": "niue", "pf": "french polynesia", "pm": "st. pierre & miquelon",
    "pn": "pitcairn islands", "ps": "palestinian territories", "pw": "palau", "re": "réunion", "sb": "solomon islands", "sd": "sudan", "sh": "st. helena", "sj": "svalbard & jan mayen", "sl": "sierra leone",
    "so": "somalia", "sr": "suriname", "ss": "south sudan", "st": "são tomé & príncipe", "sx": "sint maarten", "sz": "eswatini", "tc": "turks & caicos islands", "td": "chad", "tf": "french southern territories",
    "tg": "togo", "tj": "tajikistan", "tk": "tokelau", "tl": "timor-leste", "to": "tonga", "tt": "trinidad & tobago", "tv": "tuvalu", "tz": "tanzania", "um": "u.s. outlying islands",
    "va": "vatican city", "vc": "st. vincent & grenadines", "vg": "british virgin islands", "vi": "u.s. virgin islands", "vu": "vanuatu", "wf": "wallis & futuna", "ws": "samoa", "ye": "yemen", "yt": "mayotte",
    "zm": "zambia", "zw": "zimbabwe",
}
US_STATES: dict[str, str] = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida",
    "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "md": "maryland", "ma": "massachusetts", "mi": "michigan",
    "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico",
    "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota",
    "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    "dc": "district of columbia",
}
CA_PROVINCES: dict[str, str] = {
    "ab": "alberta", "bc": "british columbia", "mb": "manitoba", "nb": "new brunswick", "nl": "newfoundland and labrador", "ns": "nova scotia", "nt": "northwest territories",
    "nu": "nunavut", "on": "ontario", "pe": "prince edward island", "qc": "quebec", "sk": "saskatchewan", "yt": "yukon",
}
METROS = {"nyc": "new york", "la": "los angeles", "sf": "san francisco"}
#: Some cities and districts by country; the full list is a parameter.
CITIES: dict[str, str] = {
    city: country
    for country, cities in {
        "algeria": "algiers,constantine,oran", "australia": "sydney,melbourne,brisbane,perth,new south wales,queensland,south australia,western australia", "austria": "vienna,graz", "azerbaijan": "baku",
        "belgium": "brussels,antwerp,ghent", "brazil": "são paulo,rio de janeiro", "bulgaria": "sofia", "canada": "toronto,vancouver,montreal,ottawa,calgary", "china": "shanghai,beijing,shenzhen,hangzhou",
        "cyprus": "limassol,nicosia,paphos", "czechia": "prague,brno", "denmark": "copenhagen,aarhus,odense,esbjerg,roskilde,hillerød,greve,silkeborg,vejle", "estonia": "tallinn", "finland": "helsinki,turku,tampere,oulu",
        "france": "paris,lyon,nice,montpellier,toulouse", "georgia": "tbilisi", "germany": "berlin,munich,hamburg,stuttgart,düsseldorf,frankfurt,cologne,leipzig,recklinghausen,erding,offenbach am main", "greece": "athens", "hong kong": "hong kong",
        "hungary": "budapest", "india": "bangalore,bengaluru,mumbai,chennai,pune,noida,gurgaon,hyderabad", "ireland": "dublin,cork", "israel": "tel aviv,netanya,haifa", "italy": "rome,milan,pisa,turin",
        "japan": "tokyo,osaka", "kenya": "nairobi", "mexico": "mexico city,monterrey", "netherlands": "amsterdam,rotterdam,utrecht,haarlem,eindhoven,the randstad", "new zealand": "auckland,waikato,bay of plenty,taranaki,manawatu",
        "nigeria": "lagos", "norway": "oslo,bergen", "philippines": "manila", "poland": "warsaw,kraków,wrocław,wroclaw", "portugal": "lisbon,lisboa,porto", "qatar": "doha", "romania": "bucharest,cluj",
        "serbia": "belgrade", "singapore": "singapore", "slovenia": "ljubljana", "south africa": "johannesburg,cape town,durban", "south korea": "seoul", "spain": "madrid,barcelona,valencia,seville",
        "sweden": "stockholm,malmö", "switzerland": "zürich,zurich,geneva,basel", "tanzania": "dar es salaam,dar es salam", "tunisia": "tunis", "turkey": "istanbul", "ukraine": "kyiv,kiev,dnipro,lviv",
        "united arab emirates": "dubai,abu dhabi", "united kingdom": "london,manchester,liverpool,glasgow,edinburgh,oxford,cambridge,reading,guildford",
        "united states": "san francisco,los angeles,new york,atlanta,boston,chicago,austin,denver,seattle,houston,nashville,pittsburgh,miami,raleigh,san diego,bay area,orange county,washington,oklahoma,oregon,indiana,indianapolis,herndon,shreveport,bentonville,cincinnati,new kensington",
        "vietnam": "hanoi",
    }.items()
    for city in cities.split(",")
}

# Cities and areas by the state or city that they are shown with.
PARENTS: dict[str, str] = {
    "california": "redwood city,bay area,emeryville,sunnyvale,san jose,palo alto,san mateo,santa clara,hawthorne,mountain view,orange county,huntington beach,foster city,walnut,oxnard,mojave",
    "san francisco": "bay area", "washington": "bellevue,redmond,woodinville", "nevada": "las vegas", "arizona": "gilbert", "ohio": "new albany", "pennsylvania": "pittsburgh", "colorado": "denver",
    "massachusetts": "woburn", "texas": "bastrop,fort worth,mcgregor,starbase,san antonio,plano,frisco", "florida": "cape canaveral,orlando,jacksonville,miami",
    "virginia": "arlington,chantilly,virginia beach,tysons,reston,sterling", "maryland": "annapolis junction", "utah": "lehi", "oregon": "hillsboro,portland", "nebraska": "omaha",
    "illinois": "northlake", "new york": "glen cove", "alberta": "calgary", "oklahoma": "oklahoma city", "hessen": "offenbach am main", "tennessee": "memphis", "missouri": "kansas city",
    "kentucky": "louisville", "wisconsin": "milwaukee", "louisiana": "new orleans,metairie", "new jersey": "newark", "kansas": "wichita", "connecticut": "old greenwich", "georgia": "marietta",
}


def places_above(parents: dict[str, str] = PARENTS) -> dict[str, list[str]]:
    """All that stands above each place, by a table of the places under each one."""
    direct: dict[str, list[str]] = {}
    for parent, children in parents.items():
        for child in children.split(","):
            direct.setdefault(child, []).append(parent)
    above: dict[str, list[str]] = {}
    for place in direct:
        found, todo = [], list(direct[place])
        while todo:
            parent = todo.pop()
            if parent not in found and parent != place:
                found.append(parent)
                todo += direct.get(parent, [])
        above[place] = sorted(found)
    return above


GAZETTEER = "term string, kind string, value string"


def gazetteer_rows(cities: dict[str, str] | None = None, parents: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """(term, kind, value): what a segment may be. Kinds: code (another spelling), region, country, state, province, city,
    and above (a place that it is in, as a token). Cities under a state are cities of its country.

    `cities` (by country) and `parents` (places under others, with commas) replace the default ones.
    """
    parents = PARENTS if cities is None and parents is None else parents or {}
    rows = [(t, "code", v) for t, v in {**CA_PROVINCES, **US_STATES, **METROS}.items()]
    rows += [(t, "region", v) for t, v in REGIONS.items()]
    rows += [(c, "country", c) for c in COUNTRIES] + [(t, "country", v) for t, v in COUNTRY_NAMES.items()]
    rows += [(s, "state", "united states") for s in US_STATES.values()] + [(p, "province", "canada") for p in CA_PROVINCES.values()]
    above = places_above(parents)
    nation = {**(cities or CITIES), **dict.fromkeys(US_STATES.values(), "united states"), **dict.fromkeys(CA_PROVINCES.values(), "canada")}
    under = {place: nation[a] for place, over in above.items() for a in over if a in nation}
    rows += [(c, "city", v) for c, v in {**under, **(cities or CITIES)}.items()]
    rows += [(place, "above", a) for place, over in above.items() for a in over]
    return rows


_GAZETTEERS: dict[tuple, DataFrame] = {}


def gazetteer(spark: SparkSession, cities: dict[str, str] | None = None, parents: dict[str, str] | None = None) -> DataFrame:
    """The terms, made once in an application for each list of cities and parents."""
    key = (spark.sparkContext.applicationId, *(cities or {}).items(), "", *(parents or {}).items())
    if key not in _GAZETTEERS:
        _GAZETTEERS[key] = spark.createDataFrame(gazetteer_rows(cities, parents), GAZETTEER)
    return _GAZETTEERS[key]


def _or_unknown(text: Column) -> Column:
    return F.when(text == "", F.lit("Unknown")).otherwise(text)


def _no_empty_parens(text: Column) -> Column:
    """Without `()`, also where one holds another: three levels."""
    for _ in range(3):
        text = F.regexp_replace(text, r"\(\s*\)", " ")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def formatted(raw: Column) -> Column:
    """A raw location for display: blank is `Unknown`; semicolons, double commas, spaces and empty parentheses are tidied."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(text, r"\s*;\s*", ", "), r",\s*,+", ", ")
    return F.when(text == "", F.lit("Unknown")).otherwise(_no_empty_parens(F.trim(F.regexp_replace(tidy, r"\s{2,}", " "))))


def sql_formatted(raw: str) -> str:
    text = f"trim(coalesce({raw}, ''))"
    tidy = rf"regexp_replace(regexp_replace(regexp_replace({text}, '\s*;\s*', ', ', 'g'), ',\s*,+', ', ', 'g'), '\s{{2,}}', ' ', 'g')"
    for _ in range(3):
        tidy = rf"regexp_replace({tidy}, '\(\s*\)', ' ', 'g')"
    return rf"CASE WHEN {text} = '' THEN 'Unknown' ELSE trim(regexp_replace({tidy}, '\s{{2,}}', ' ', 'g')) END"


def tidied(place: Column) -> Column:
    """A location without wide gaps, and without separators at its ends."""
    return F.regexp_replace(F.regexp_replace(place, r"\s{2,}", " "), r"^[\s,;/|–-]+|[\s,;/|–-]+$", "")


def employer_in(place: Column, company: Column, flat: Column | None = None) -> Column:
    """What `without_company` has to know of an employer: its name where it stands in a location, null where it doesn't.

    Names that are blank, or too short to be looked for, are "". `flat`, if at hand, is `flattened(place)`.
    """
    name = F.trim(F.coalesce(company, F.lit("")))
    inside = (flattened(place) if flat is None else flat).contains(flattened(name))
    short = (~name.contains(" ")) & (F.char_length(name) < 3)
    return F.when((name == "") | short & (F.lower(F.trim(place)) != F.lower(name)), F.lit("")).when(inside, name)


def flattened(text: Column) -> Column:
    """A location or a name as they are compared: lower case, no gap wider than one."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def without_company(raw: Column, company: Column, tidy: Column | None = None) -> Column:
    """A location without the employer's name; `Unknown` where there is nothing else. `tidy`, if at hand, is `tidied(raw)`."""
    return without_employer(raw, employer_in(raw, company), tidy)


def without_employer(raw: Column, employer: Column, tidy: Column | None = None) -> Column:
    """The same, where `employer_in` has been asked before.

    Only locations that hold the name at all are searched by a pattern made of it.
    """
    place = F.trim(raw)
    tidy = tidied(place) if tidy is None else tidy
    escaped = F.regexp_replace(F.regexp_replace(employer, r"([.^$*+?{}\[\]\\|()])", r"\\$1"), r"\s+", r"\\s+")
    cut = F.when(employer.isNotNull(), tidied(F.regexp_replace(place, F.concat(F.lit("(?i)" + EDGE), escaped, F.lit(EDGE)), F.lit(" ")))).otherwise(tidy)
    return F.when((place == "") | F.coalesce(employer == "", F.lit(False)), place).when(F.lower(place) == F.lower(employer), "Unknown").when(cut == "", place).otherwise(_no_empty_parens(cut))


#: What is said about a place besides its name, and what stands for it: (pattern, replacement), in order. A parameter of `facets`.
REWRITES: tuple[tuple[str, str], ...] = (
    (r"(?i)^\s*(?:all|no|any|other|various)\s+(?:locations?|hubs|offices)\s*$|^\s*(?:field|permanent|talent\s+pool|passive\s+posting|hq|labs)\s*$", ""),
    (r"(?i)\([^)]*\b(?:hours?|cet|cest|utc|gmt|time\s*zones?)\b[^)]*\)|\b(?:cet|cest|utc)\b", " "),
    (r"(?i)^\s*fully\s+remote\s*$|\bglobal\s*,?\s*remote\b|\bremote\s*-?\s*(?:international|anywhere\s+in\s+the\s+world)\b|\bremote\s*\(\s*world\s*\)", "Worldwide"),
    (r"(?i)\bfully\s+remote\b\s*,?|\b(?:relocation\s+to|virtual|work\s+from\s+home)\b|\bhq\s*:", " "),
    (r"(?i)\bd\.\s*c\.?", "DC"),
    (r"(\p{L}{4,})\d+\b", "$1"),
    (r"(?i)\s+l\s+remote\b", " | Remote"),
    (r"(?i)\bgreater\s+(\p{L}[\p{L} ]*?)\s+area\b", "$1"),
    (r"(\p{L}{2,})-\s+", "$1 - "),
    (r"(?i)\b(\p{L}{2,})-remote\b", "$1 | Remote"),
    (r"(?i)\bremote-+(\p{L}{2,})", "Remote | $1"),
)


#: Letters with marks by how they are written apart, for the alphabets that have them.
COMPOSED: dict[str, str] = {
    apart: c
    for c in map(chr, (*range(0xC0, 0x250), *range(0x370, 0x500), *range(0x1E00, 0x2000)))
    if len(apart := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", apart) == c
}
_MARKS = "\u0300-\u036f"


def composed(text: Column) -> Column:
    """A text whose letters are one with their marks; only texts with marks of their own are taken apart."""
    # One literal for each side, which Spark folds into one map: hundreds of literals take long to parse.
    table = F.map_from_arrays(*(F.split(F.lit(",".join(side)), ",") for side in (COMPOSED.keys(), COMPOSED.values())))
    letters = F.regexp_extract_all(text, F.lit(f"(?s)[^{_MARKS}][{_MARKS}]*|[{_MARKS}]+"), F.lit(0))
    whole = F.array_join(F.transform(letters, lambda c: F.coalesce(F.when(F.char_length(c) > 1, F.element_at(table, c)), c)), "")
    return F.when(text.rlike(f"[{_MARKS}]"), whole).otherwise(text)


def rewritten(raw: Column, rewrites: tuple[tuple[str, str], ...] = REWRITES) -> Column:
    """A raw location with the rewrites made."""
    text = F.coalesce(raw, F.lit(""))
    for pattern, by in rewrites:
        text = replaced(text, pattern, by)
    return text


def sql_rewritten(raw: str) -> str:
    text = f"coalesce({raw}, '')"
    for pattern, by in REWRITES:
        text = f"regexp_replace({text}, '{quoted(pattern)}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return text


# Phrases as boards write them, and what they stand for. A table of the user's can take their place.
PHRASES: tuple[Rule, ...] = tuple(
    (phase, *(x.strip() for x in line.split("->")), whole)
    for phase, whole, lines in (
        (
            0,
            False,
            """
            east, us region -> United States
            west, us region -> West Coast, United States
            west us region -> West Coast, United States
            ohio valley, us region -> United States
            greater toronto area -> Toronto, Canada
            hang zhou -> Hangzhou
            shang hai -> Shanghai
            unites states -> United States
            united state -> United States
            (gift city) -> , gift city
            india-bangalore -> Bangalore, India
            india bangalore -> Bangalore, India
            quebec city, quebec -> Quebec City, QC, Canada
            québec city, québec -> Quebec City, QC, Canada
            anywhere in europe and south america -> Europe | South America
            europe and south america -> Europe | South America
            remoto -> Remote
            híbrido, -> Remote |
            hibrido, -> Remote |
            zürich, ch -> Zürich, Switzerland
            zurich, ch -> Zürich, Switzerland
            remote us east -> East Coast, United States
            remote us west -> West Coast, United States
            remote us central -> Central US, United States
            remote position -> Remote
            virtual us -> United States
            remote - aus -> Australia
            remote - ind -> India
            remote - ga -> Georgia, United States
            remote - in -> Indiana, United States
            remote - or -> Oregon, United States
            remote - ok -> Oklahoma, United States
            remote - north tx -> Texas, United States
            remote - va & ky -> Virginia, United States; Kentucky, United States
            remote - calgary -> Calgary, Canada
            remote - vancouver -> Vancouver, Canada
            remote - boston metro -> Boston, MA
            remote: boston area -> Boston, MA
            remote: northeast us -> East Coast, United States
            remote (northeast) -> East Coast, United States
            remote (southeast) -> Southeast US, United States
            remote - new england -> East Coast, United States
            southern california - remote -> California, United States
            oregon - remote -> Oregon, United States
            usa - remote -> United States
            latin america - remote -> Latin America
            remote-central america -> Latin America
            remote-northeast asia -> Northeast Asia
            remote-uk&i -> United Kingdom, Ireland
            remote-dach -> Germany, Austria, Switzerland
            remote roles - cis -> CIS
            phl remote -> Philadelphia, PA
            ind remote -> India
            northeastern us -> East Coast, United States
            southeastern us -> Southeast US, United States
            central / western us -> United States
            central us -> Central US, United States
            raleigh - durham -> Raleigh, NC
            indianapolis, in -> Indianapolis, Indiana
            portland, or -> Portland, Oregon
            portland or -> Portland, Oregon
            hillsboro, or -> Hillsboro, Oregon
            hillsboro or -> Hillsboro, Oregon
            toronto canada -> Toronto, Canada
            singapore city -> Singapore
            uae abu dhabi -> Abu Dhabi, United Arab Emirates
            kwazulu natal -> South Africa
            mainland china (remote) -> China
            frankfurt am main -> Frankfurt
            ft. meade -> Fort Meade, MD
            ft meade -> Fort Meade, MD
            ny-new york -> New York, NY
            sf-san francisco -> San Francisco, CA
            north carolina - charlotte -> Charlotte, NC
            canada & usa -> Canada, United States
            usa & canada -> United States, Canada
            canada & us -> Canada, United States
            us & canada -> United States, Canada
            united states & emea -> United States, EMEA
            emea & united states -> EMEA, United States
            flexible - any site -> United States
            """,
        ),
        (
            0,
            True,
            """
            add all locations here ->
            btc ->
            on-site at project location ->
            """,
        ),
    )
    for line in lines.strip().splitlines()
)


SEPARATORS = r"(?i)\s*[;/|]\s*|\s+[-–—]\s+|\s*\+\s*|\s{2,}|\s+or\s+"


def segments(raw: Column) -> Column:
    """The alternatives a location lists, in order: split at ; / | + spaced hyphens, wide gaps and `or`, parentheses opened."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\(\s*([^)|,]*?)\s*\)", " $1 ")
    text = F.regexp_replace(text, r"\(\s*([^)]*?)\s*\)", ";$1")
    return F.filter(F.transform(F.split(text, SEPARATORS), trimmed), lambda s: s != "")


def sql_segments(raw: str) -> str:
    text = rf"regexp_replace(coalesce({raw}, ''), '\(\s*([^)|,]*?)\s*\)', ' \1 ', 'g')"
    text = rf"regexp_replace({text}, '\(\s*([^)]*?)\s*\)', ';\1', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({text}, '{SEPARATORS}'), lambda s: trim(s)), lambda s: s <> '')"


_NOISE = r"\b(?:anywhere\s+in|hq|headquarters|head\s+office|in[\s-]?office|office|hybrid|onsite|remote|anywhere|select\s+locations|all\s+locations|any\s+location)\b"


#: Words behind a place that say no more about it.
_AFTER = r"\s+(?:metro(?:politan)?(?:\s+area)?|team|warehouse|campus|full[\s-]?time)$|[\s-]+based$"


def cleaned_segment(segment: Column) -> Column:
    """Lower case, without words about the way of working and without punctuation at the ends."""
    text = replaced(F.lower(segment), _NOISE)
    text = F.regexp_replace(F.regexp_replace(text, r"[.;:]", " "), r"\s+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"^[\s,–—-]+|[\s,–—-]+$", ""), r"^in\s+|\s+in$", "")
    text = F.regexp_replace(text, _AFTER, "")
    return F.when(text.endswith("bay area"), text).otherwise(F.regexp_replace(text, r"\s+area$", ""))


def sql_cleaned_segment(segment: str) -> str:
    text = f"regexp_replace(lower({segment}), '{_NOISE}', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[.;:]', ' ', 'g'), '\s+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '^[\s,–—-]+|[\s,–—-]+$', '', 'g'), '^in\s+|\s+in$', '', 'g')"
    text = f"regexp_replace({text}, '{_AFTER}', '')"
    return rf"CASE WHEN ends_with({text}, 'bay area') THEN {text} ELSE regexp_replace({text}, '\s+area$', '') END"


def _tail(words: list[str]) -> str:
    """A closing word of this list after another one: becomes a bit of its own."""
    return r"^(.+?)\s+(" + "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")$"


TAILS = (_tail(list(US_STATES)), _tail(list(US_STATES.values())), _tail(["uk", "ch", "uae", "usa"]), _tail(COUNTRIES))


#: Whole names that end in a country's.
WHOLE = ("south australia", "western australia", "northern australia", "tasmanian australia")


def _cut_tail(tail: str, bit: Column) -> Column:
    return F.when(bit.isin(*WHOLE), F.array(bit)).otherwise(_cut(tail, bit))


def _cut(tail: str, bit: Column) -> Column:
    return F.split(F.regexp_replace(bit, tail, "$1,$2"), ",")


def bits(segment: Column) -> Column:
    """A cleaned segment's parts: at commas, and before a closing state, code or country."""
    split = F.filter(F.transform(F.split(segment, r"\s*,\s*"), lambda x: F.trim(x)), lambda b: b != "")
    for tail in TAILS:
        split = F.flatten(F.transform(split, partial(_cut_tail, tail)))
    return F.filter(F.transform(split, lambda b: F.regexp_replace(F.trim(b), r"^in\s+", "")), lambda b: b != "")


def sql_bits(segment: str) -> str:
    split = rf"list_filter(list_transform(regexp_split_to_array({segment}, '\s*,\s*'), lambda b: trim(b)), lambda b: b <> '')"
    for tail in TAILS:
        split = rf"flatten(list_transform({split}, lambda b: CASE WHEN b IN ('south australia', 'western australia', 'northern australia', 'tasmanian australia') THEN [b] ELSE string_split(regexp_replace(b, '{quoted(tail)}', '\1,\2'), ',') END))"
    return rf"list_filter(list_transform({split}, lambda b: regexp_replace(trim(b), '^in\s+', '')), lambda b: b <> '')"


_KINDS = ("region", "country", "state", "province", "city")
#: A city may be named after one of these words; what follows them is no place of its own then.
LEADING = ("new", "north", "south", "east", "west", "central", "northern", "southern", "eastern", "western", "northeast", "northwest", "southeast", "southwest", "baja", "port", "fort", "saint", "st", "san", "santa", "upper", "lower", "old", "and", "&")
JOINTS = r"\s+and\s+|\s*&\s*|-"


def indexed(terms: DataFrame) -> DataFrame:
    """A row for each term: `bit`, the `code` it stands for, if any, its `term` (the code's, or itself), and what that is."""
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    above = F.array_sort(F.collect_set(F.when(F.col("kind") == "above", F.col("value")))).alias("above")
    wide = terms.groupBy("term").agg(one("code"), *map(one, _KINDS), above)
    keyed = wide.select(F.col("term").alias("bit"), "code", F.coalesce("code", "term").alias("key"))
    return keyed.join(wide.select(F.col("term").alias("key"), *_KINDS, "above"), "key", "left").withColumnRenamed("key", "term")


_INDEXES: list[tuple[str, DataFrame, DataFrame]] = []


def index_of(terms: DataFrame) -> DataFrame:
    """`indexed(terms)`, written once in an application for each table of terms."""
    app = terms.sparkSession.sparkContext.applicationId
    for known, of, index in _INDEXES:
        if known == app and of.sameSemantics(terms):
            return index
    _INDEXES.append((app, terms, stored(indexed(terms))))
    return _INDEXES[-1][2]


def _together(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Segments joined by `and`, `&` or a hyphen come apart where every piece is a known term."""
    pieces = F.filter(F.transform(F.split("text", JOINTS), lambda x: F.trim(x)), lambda x: x != "")
    joint = parts.where(F.col("text").rlike(JOINTS)).select("text").distinct().withColumn("pieces", pieces)
    met = joint.select("text", "pieces", F.explode("pieces").alias("bit")).join(known, "bit", "left")
    whole = met.groupBy("text").agg(F.bool_and(F.col("known").isNotNull()).alias("all"), F.first("pieces").alias("pieces"), F.count(F.lit(1)).alias("n"))
    apart = whole.where(F.col("all") & (F.col("n") > 1)).select("text", "pieces")
    return parts.join(apart, "text", "left").select("raw", "segment", F.explode(F.coalesce("pieces", F.array("text"))).alias("text"))


def _peeled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Bits of several words that are no term, but end in one behind words of which none is: the rest is an employer's name."""
    words = F.split("bit", " ")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(words) - 1)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, -k, k), " ").alias("bit")))
    asked = rows.where(F.col("bit").contains(" ")).select("bit").distinct().withColumn("words", words).where(F.size("words") <= 9)
    # The whole, its ends and its single words are looked up together.
    every = F.array_union(F.array("bit"), F.array_union(F.transform(ends, lambda e: e["bit"]), F.col("words")))
    met = asked.select(F.col("bit").alias("whole"), F.explode(every).alias("bit")).join(known, "bit").groupBy("whole").agg(F.collect_set("bit").alias("found"))
    met = met.select(F.col("whole").alias("bit"), "found").where(~F.array_contains("found", F.col("bit")))
    fits = lambda e: F.array_contains("found", e["bit"]) & ((F.char_length(e["bit"]) >= 4) | e["bit"].contains(" "))
    before = lambda e: F.slice(words, 1, F.size(words) - e["k"])
    free = lambda e: ~F.arrays_overlap(before(e), F.col("found")) & ~F.get(before(e), F.size(words) - e["k"] - 1).isin(*LEADING)
    fitting = F.filter(ends, fits)
    longest = F.get(fitting, F.size(fitting) - 1)
    best = met.withColumn("end", longest).where("end IS NOT NULL").where(free(F.col("end"))).select("bit", F.col("end.bit").alias("best"))
    return rows.join(best, "bit", "left").withColumn("bit", F.coalesce("best", "bit")).drop("best")


#: An employer's name has so many words at most, where it is looked for in front of a place.
EMPLOYER_WORDS = 6


def _without_employers(parts: DataFrame, employers: DataFrame, known: DataFrame) -> DataFrame:
    """Segments without a known employer's name at either end, the longest one, where what is left is a known place or none.

    The names are a table of any size: ends of the distinct segments are joined with them. They are read as segments are,
    so case, gaps and points don't matter. A name that is a place itself (`Paris`) is none here.
    """
    names = employers.toDF("name").select(cleaned_segment(F.col("name")).alias("name")).where("name != ''").distinct().join(known.select(F.col("bit").alias("name")), "name", "left_anti")
    words = F.split("text", " ")
    lengths = F.sequence(F.lit(1), F.least(F.lit(EMPLOYER_WORDS), F.size(words) - 1))
    cut = lambda a, n: F.regexp_replace(F.array_join(F.slice(words, a, n), " "), r"^[\s,–—-]+|[\s,–—-]+$", "")
    front = F.transform(lengths, lambda k: F.struct(k.alias("k"), cut(F.lit(1), k).alias("name"), cut(k + 1, F.size(words) - k).alias("bit")))
    back = F.transform(lengths, lambda k: F.struct(k.alias("k"), cut(F.size(words) - k + 1, k).alias("name"), cut(F.lit(1), F.size(words) - k).alias("bit")))
    asked = parts.where(F.col("text").contains(" ")).select("text").distinct().select("text", F.explode(F.concat(front, back)).alias("end")).select("text", "end.*")
    ends = asked.join(names, "name").join(known, "bit").select("text", "k", "bit")
    # A segment that is a name and nothing else says no place.
    whole = parts.select("text").distinct().join(names.select(F.col("name").alias("text")), "text").select("text", F.size(words).alias("k"), F.lit("").alias("bit"))
    met = ends.union(whole).groupBy("text").agg(F.max(F.struct("k", "bit"))["bit"].alias("place"))
    return parts.join(met, "text", "left").withColumn("text", F.coalesce("place", "text")).select(*parts.columns)


def facets(places: DataFrame, terms: DataFrame, raw: str = "location_raw", rewrites: tuple[tuple[str, str], ...] = REWRITES, phrases: Iterable[Rule] = PHRASES, employers: DataFrame | None = None) -> DataFrame:
    """A row for each distinct string of `raw`: tokens, countries and regions, sorted.

    Letters are made one with their marks, phrases and then patterns are rewritten. A city that lies under a state brings
    that as a token, unless its segment names a state itself (`Portland` is in Oregon, `Portland, TX` isn't).
    `DE` and `NL` are the country beside one of its cities; `Georgia` is the state beside the United States or one of its
    cities. A null string has empty facets. The gazetteer is the user's: Spark broadcasts it as long as it is small.

    `employers`, a table of names (such as the company column), tells names with places in them from places.

    Strings, the gazetteer and the strings' bits are written, as each is read several times.
    """
    strings = stored(places.select(F.col(raw).alias("raw")).distinct())
    index = index_of(terms)
    known = index.where(F.coalesce("code", *_KINDS).isNotNull()).select("bit", F.lit(True).alias("known"))
    said = strings.select("raw", rewriter(phrases)(composed(F.col("raw"))).alias("said"))
    parts = said.select("raw", F.posexplode(segments(rewritten(F.col("said"), rewrites))).alias("segment", "text"))
    parts = parts.withColumn("text", cleaned_segment(F.col("text")))
    parts = _together(parts if employers is None else _without_employers(parts, employers, known), known)
    split = stored(parts.select("raw", "segment", F.explode(F.array_distinct(bits(F.col("text")))).alias("bit")))
    met = _peeled(split, known).distinct().join(index, "bit", "left").withColumn("term", F.coalesce("term", "bit"))
    # What stands in the same segment decides ambiguous codes: one group is one segment of one string.
    beside = met.groupBy("raw", "segment").agg(F.collect_list(F.struct("bit", "term", "code", *_KINDS, "above")).alias("all"))
    near = lambda place: F.exists("all", lambda x: (x["city"] == place) | (x["country"] == place))
    beside = beside.select("raw", "segment", F.exists("all", lambda x: x["city"] == "germany").alias("german"), F.exists("all", lambda x: x["city"] == "netherlands").alias("dutch"), near("united states").alias("american"), F.exists("all", lambda x: x["state"].isNotNull() | x["province"].isNotNull()).alias("stately"), F.explode("all").alias("x")).select("raw", "german", "dutch", "american", "stately", "x.*")
    german = (F.col("bit") == "de") & F.coalesce("german", F.lit(False))
    dutch = (F.col("bit") == "nl") & F.coalesce("dutch", F.lit(False))
    stated = F.coalesce("american", F.lit(False)) & (F.col("term") == "georgia")
    nation = F.when(german, "germany").when(dutch, "netherlands").when(stated | F.col("code").isNotNull(), None).otherwise(F.col("country"))
    subnational = F.when(german | dutch, None).when(F.col("state").isNotNull() & (F.col("country").isNull() | stated), "united states").when(F.col("province").isNotNull(), "canada")
    token = F.when(german, "germany").when(dutch, "netherlands").otherwise(F.coalesce("region", "country", "term"))
    implied = F.when(~F.coalesce("stately", F.lit(False)) & F.col("above").isNotNull(), F.col("above")).otherwise(F.array().cast("array<string>"))
    rows = beside.select("raw", F.explode(F.array_union(F.array(token), implied)).alias("token"), F.array(nation, subnational, F.col("city")).alias("lands"), "region")
    rows = rows.select("raw", "token", F.explode("lands").alias("country"), "region")
    gathered = rows.groupBy(F.col("raw").alias("_gathered")).agg(F.collect_set("token").alias("t"), F.collect_set("country").alias("c"), F.collect_set("region").alias("r"))
    out = strings.join(gathered, F.col("raw") == F.col("_gathered"), "left")
    none = F.array().cast("array<string>")
    t, c, r = (F.coalesce(F.col(x), none) for x in "tcr")
    return out.select(F.col("raw").alias(raw), F.array_sort(F.array_union(t, c)).alias("tokens"), F.array_sort(c).alias("countries"), F.array_sort(r).alias("regions"))


def sql_facets(source: str, raw: str = "location_raw") -> str:
    """The same as a query over `source`, with the arrays joined by commas."""
    values = ", ".join(f"('{quoted(t)}', '{k}', '{quoted(v)}')" for t, k, v in gazetteer_rows())
    lookups = " ".join(f"LEFT JOIN (SELECT term, value FROM terms WHERE kind = '{k}') {k} ON {k}.term = keyed.key" for k in _KINDS)
    leading = ", ".join(f"'{w}'" for w in LEADING)
    return f"""
WITH terms(term, kind, value) AS (VALUES {values}),
lexicon AS (SELECT list(DISTINCT term) AS lex FROM terms),
strings AS (SELECT DISTINCT {raw} AS raw FROM {source}),
parts AS (SELECT raw, generate_subscripts(s, 1) AS segment, unnest(s) AS piece FROM (SELECT raw, {sql_segments(sql_rewritten('said'))} AS s FROM (SELECT raw, {sql_rewrite("nfc_normalize(raw)", PHRASES)} AS said FROM strings))),
cleaned AS (SELECT raw, segment, {sql_cleaned_segment('piece')} AS text FROM parts),
joint AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '{JOINTS}'), lambda x: trim(x)), lambda x: x <> '') AS pieces FROM cleaned),
loose AS (SELECT raw, segment, unnest(CASE WHEN len(pieces) > 1 AND list_has_all(lex, pieces) THEN pieces ELSE [text] END) AS text FROM joint, lexicon),
whole AS (SELECT raw, segment, unnest(list_distinct({sql_bits('text')})) AS bit FROM loose),
worded AS (SELECT *, string_split(bit, ' ') AS words FROM whole),
ended AS (SELECT worded.*, lex, list_filter(list_transform(range(1, least(5, len(words))), lambda k: k), lambda k: list_contains(lex, array_to_string(words[len(words) - k + 1:], ' '))
    AND (length(array_to_string(words[len(words) - k + 1:], ' ')) >= 4 OR k > 1))[-1] AS k FROM worded, lexicon),
split AS (SELECT DISTINCT raw, segment, CASE WHEN k IS NOT NULL AND len(words) <= 9 AND NOT list_contains(lex, bit) AND NOT list_has_any(lex, words[1:len(words) - k])
    AND words[len(words) - k] NOT IN ({leading}) THEN array_to_string(words[len(words) - k + 1:], ' ') ELSE bit END AS bit FROM ended),
keyed AS (SELECT split.*, c.value AS code, coalesce(c.value, bit) AS key FROM split LEFT JOIN (SELECT term, value FROM terms WHERE kind = 'code') c ON c.term = bit),
known AS (
  SELECT keyed.*, above.value AS above, bool_or(state.value IS NOT NULL OR province.value IS NOT NULL) OVER w AS stately, region.value AS region, country.value AS country, state.value AS state, province.value AS province, city.value AS city,
         bool_or(coalesce(city.value = 'germany', false)) OVER w AS german, bool_or(coalesce(city.value = 'netherlands', false)) OVER w AS dutch,
         bool_or(coalesce(city.value = 'united states' OR country.value = 'united states', coalesce(city.value, country.value, '') = 'united states')) OVER w AS american
  FROM keyed {lookups} LEFT JOIN (SELECT term, list(value) AS value FROM terms WHERE kind = 'above' GROUP BY term) above ON above.term = keyed.key WINDOW w AS (PARTITION BY keyed.raw, keyed.segment)
), decided AS (
  SELECT raw, CASE WHEN bit = 'de' AND german THEN 'germany' WHEN bit = 'nl' AND dutch THEN 'netherlands' ELSE coalesce(region, country, key) END AS token, region,
         unnest([CASE WHEN bit = 'de' AND german THEN 'germany' WHEN bit = 'nl' AND dutch THEN 'netherlands' WHEN (american AND key = 'georgia') OR code IS NOT NULL THEN NULL ELSE country END,
                 CASE WHEN (bit = 'de' AND german) OR (bit = 'nl' AND dutch) THEN NULL WHEN state IS NOT NULL AND (country IS NULL OR (american AND key = 'georgia')) THEN 'united states'
                      WHEN province IS NOT NULL THEN 'canada' END, city]) AS country
  FROM known
  UNION ALL SELECT raw, unnest(above), NULL, NULL FROM known WHERE NOT stately
), gathered AS (
  SELECT raw, list_filter(list(DISTINCT token), lambda x: x IS NOT NULL) AS t, list_filter(list(DISTINCT country), lambda x: x IS NOT NULL) AS c, list_filter(list(DISTINCT region), lambda x: x IS NOT NULL) AS r
  FROM decided GROUP BY raw
)
SELECT strings.raw AS {raw}, coalesce(array_to_string(list_sort(list_distinct(list_concat(t, c))), ','), '') AS tokens,
       coalesce(array_to_string(list_sort(c), ','), '') AS countries, coalesce(array_to_string(list_sort(r), ','), '') AS regions
FROM strings LEFT JOIN gathered ON strings.raw IS NOT DISTINCT FROM gathered.raw"""


def _chain(value: Column, *tables: dict[str, str]) -> Column:
    pairs = {k: v for t in reversed(tables) for k, v in t.items()}
    table = F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs.items()) + ")")
    return F.coalesce(F.element_at(table, value), value)


#: Precedence of hints: other names, then ISO codes, then regions.
HINTS: dict[str, str] = {**REGIONS, **ISO2, **COUNTRY_NAMES}


def country_hint(hint: Column) -> Column:
    """The stored name that a board's country hint stands for, or the hint itself in lower case."""
    return _chain(F.lower(F.trim(hint)), HINTS)


def sql_country_hint(hint: str) -> str:
    low = f"lower(trim({hint}))"
    return f"CASE {low} " + " ".join(f"WHEN '{quoted(k)}' THEN '{quoted(v)}'" for k, v in HINTS.items()) + f" ELSE {low} END"


def split_hints(hints: Column) -> Column:
    """Distinct canonical hints of an array of strings such as `US | EU`."""
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(hints, lambda h: F.split(h, r"[|,;/]"))), country_hint), lambda h: h != ""))


# Hints that name a region; they are taken as they are.
REGION_HINTS = ("apac", "emea", "latam", "mena", "americas", "north america", "south america", "asia", "europe", "european union", "eu", "east coast", "west coast")


def merged_with_hints(found: Column, hints: Column) -> Column:
    """Facets (a struct of tokens, countries and regions) with a board's hints added."""
    low = F.filter(F.transform(hints, lambda h: F.lower(F.trim(h))), lambda h: h != "")
    regions = F.array_union(found["regions"], F.filter(low, lambda h: h.isin(*REGION_HINTS)))
    named = F.filter(split_hints(F.filter(low, lambda h: ~h.isin(*REGION_HINTS))), lambda h: h.isin(*COUNTRIES))
    countries = F.array_union(found["countries"], named)
    tokens = F.array_union(F.array_union(found["tokens"], countries), regions)
    return F.when(F.size(low) > 0, F.struct(tokens.alias("tokens"), countries.alias("countries"), regions.alias("regions"))).otherwise(found)


# Places that `remote` is tied to when it stands beside them.
REMOTE_COUNTRIES = ("us", "usa", r"u\.s\.a?\.?", "uk", r"u\.k\.", "eu", "ca", "canada", "india", "germany", "france", "australia", "poland", "ireland", "netherlands", "spain", "italy", "mexico", "brazil", "japan", "singapore")
REMOTE_REGIONS = ("emea", "apac", "latam", "mena", "noram", "nordics", "dach", "iberia")


def _tied(words: tuple[str, ...]) -> str:
    among = "|".join(words)
    return rf"(?i)\b({among})\s+remote\b|\bremote\s*(?:[-–—:,/]\s*|\s+)({among})(?:\b|$)"


def tied_to_region(text: Column) -> Column:
    return has(text, _tied(REMOTE_REGIONS))


def remote_countries(text: Column) -> Column:
    """Countries that `remote` is tied to in a text, as in `US Remote` or `remote - Germany`."""
    pattern = F.lit(_tied(tuple(w for w in REMOTE_COUNTRIES)).replace(r"\b(", r"(?<![A-Za-z0-9_])(").replace(r"remote\b", "remote(?![A-Za-z0-9_])").replace(r"\bremote", "(?<![A-Za-z0-9_])remote").replace(r"(?:\b|$)", "(?![A-Za-z0-9_])"))
    body = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(body, pattern, F.lit(1)), F.regexp_extract_all(body, pattern, F.lit(2)))
    names = F.transform(F.filter(found, lambda x: x != ""), lambda x: country_hint(F.replace(x, F.lit("."), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isin(*COUNTRIES))))


def country_mentions(text: Column) -> Column:
    """Countries named in a text, in full or by a safe short name, between characters that are no letters or digits."""
    names = {c: (c,) for c in COUNTRIES} | {k: (v,) for k, v in COUNTRY_NAMES.items() if len(k) >= 4 or k in ("usa", "uae", "uk", "ch")}
    return F.array_sort(F.array_distinct(words_found(F.lower(F.coalesce(text, F.lit(""))), names, r"\p{L}\p{M}\p{N}")))


def without_remote(place: Column) -> Column:
    """A location without `remote` and `anywhere`, its parts separated by commas and each named once."""
    text = _no_empty_parens(place)
    text = replaced(text, r"(?i)\b(?:remote|anywhere)\b", "")
    for pattern, by in ((r"(?i)^\s*(?:or|and|&)\s+|\s+(?:or|and|&)\s*$", ""), (r"(?i)(?:^|,)\s*(?:or|and|&)\s*,", ",")):
        text = F.regexp_replace(text, pattern, by)
    # Labels such as `in-office` keep their hyphen.
    text = F.regexp_replace(text, r"(?i)\b(in|on)-(office|site)\b", "$1‑$2")
    parts = F.filter(F.transform(F.split(text, r"\s*[-/|,]+\s*"), lambda p: F.regexp_replace(F.trim(p), r"\s{2,}", " ")), lambda p: p != "")
    same = lambda p: _chain(F.lower(p), {"uk": "united kingdom", "us": "united states", "usa": "united states", "uae": "united arab emirates", "czech republic": "czechia", "republic of korea": "south korea"})
    keys = F.transform(parts, same)
    # Of parts with one key the first place counts, and the full name if it occurs.
    once = F.transform(F.array_distinct(keys), lambda k: F.coalesce(F.get(F.filter(parts, lambda p: F.lower(p) == k), F.lit(0)), F.get(F.filter(parts, lambda p: same(p) == k), F.lit(0))))
    return _or_unknown(F.replace(_no_empty_parens(F.array_join(once, ", ")), F.lit("‑"), F.lit("-")))


def resolved(place: Column, has_geography: Column, remote_by_board: Column) -> Column:
    """`Remote` where a text names no country or region but speaks of remote work, or is blank on a remote posting; else cleaned."""
    blank = F.lower(F.trim(place)).isin("", "unknown")
    remote = has(place, r"(?i)\b(?:remote|anywhere|distributed)\b") | (remote_by_board & blank)
    return F.when(~has_geography & remote, F.lit("Remote")).when(blank, F.lit("Unknown")).otherwise(without_remote(place))


def display_parts(raw: Column, location: Column, provider: Column) -> Column:
    """A struct of the primary location and the others, for display."""
    text = trimmed(F.coalesce(raw, F.lit("")))
    parts = lambda at: F.filter(F.transform(F.split(text, at), lambda x: F.trim(x)), lambda p: p != "")
    bars, commas = parts(r"\|"), parts(",")
    of = lambda first, rest: F.struct(first.alias("primary"), rest.alias("others"))
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))
    places = F.filter(commas, lambda p: F.lower(p) != "remote")
    first = F.get(places, F.lit(0))
    remote = of(F.when(first.isNotNull(), F.concat(first, F.lit(", Remote"))).otherwise("Remote"), F.filter(places, lambda p: p != F.coalesce(first, F.lit(""))))
    return (
        F.when(text.contains("|") & (F.size(bars) > 0), of(F.get(bars, F.lit(0)), rest(bars)))
        .when((provider == "ashby") & (F.size(commas) > F.size(places)), remote)
        .when((provider == "ashby") & (F.size(commas) > 0), of(F.get(commas, F.lit(0)), rest(commas)))
        .otherwise(of(location, F.array().cast("array<string>")))
    )


SHORT_NAMES = {"united states": any_of("usa", "us"), "united kingdom": r"(?i)\buk\b", "united arab emirates": r"(?i)\buae\b"}


def country_token(name: str) -> str:
    """A selected country as it is stored."""
    low = name.strip().lower()
    return {"us": "united states", "usa": "united states", "uk": "united kingdom", "uae": "united arab emirates"}.get(low, low)
