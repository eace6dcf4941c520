"""Parenthesised naming conventions as column expressions.

The grammar is the public preservation convention, ``Title (Regions) (Languages)
(Version) (Release) (Flags)``: what a group is follows from its content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Region names and their codes.
REGIONS = {
    "Asia": "ASI", "Argentina": "AR", "Australia": "AU", "Austria": "AT", "Belgium": "BE", "Brazil": "BR", "Bulgaria": "BG", "Canada": "CA", "Chile": "CL", "China": "CN",
    "Croatia": "HR", "Czech": "CZ", "Denmark": "DK", "Europe": "EU", "Finland": "FI", "France": "FR", "Germany": "DE", "Greece": "GR", "Hong Kong": "HK", "Hungary": "HU",
    "India": "IN", "Ireland": "IE", "Israel": "IL", "Italy": "IT", "Japan": "JP", "Korea": "KR", "Latin America": "LA", "Mexico": "MX", "Netherlands": "NL", "New Zealand": "NZ",
    "Norway": "NO", "Poland": "PL", "Portugal": "PT", "Romania": "RO", "Russia": "RU", "Scandinavia": "SCN", "Singapore": "SG", "Slovakia": "SK", "South Africa": "ZA", "Spain": "ES",
    "Sweden": "SE", "Switzerland": "CH", "Taiwan": "TW", "Thailand": "TH", "Turkey": "TR", "UK": "GB", "Ukraine": "UA", "United Arab Emirates": "AE", "USA": "US", "World": "US-JP-EU", "Unknown": "ZZ",
}
RELEASES = ("Alpha", "Beta", "Demo", "Kiosk", "Possible Proto", "Preview", "Program", "Promo", "Proto", "Prototype", "Sample", "Test Program")
_RELEASE = rf"^({'|'.join(sorted(RELEASES, key=len, reverse=True))})( [0-9]+)?$"
_LANGUAGES = r"^[A-Z][a-z](-[A-Z]{2})?([,+][A-Z][a-z](-[A-Z]{2})?)*$"
_VERSION = r"^(?:Rev ([0-9A-Z.]+)|[vV]([0-9][0-9A-Za-z.]*)|Version ([0-9][0-9A-Za-z.]*))$"
#: Title, optional demo mark, date with unknown digits as x, publisher; what follows is captured.
_DATED = r"^[^()]+(?:\(demo[^()]*\) ?)?\((?:19|20)[0-9x]{2}(?:-[0-9x]{2}){0,2}\)\([^()]*\)(.*)$"
_MEDIA = r"^(Disc|Disk|Side|Tape|Cart|Part|Track) [0-9A-Z]+"


def _region_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])


def groups(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit(r"\(([^()]*)\)"), 1)


def title(name: Column) -> Column:
    return F.btrim(F.regexp_extract(name, r"^([^(\[]*)", 1))


def _is_region(group: Column) -> Column:
    return F.forall(F.split(group, ", "), lambda p: F.map_contains_key(_region_map(), p))


def region_codes(name: Column) -> Column:
    """Codes of the first group of regions, joined by ``-``; empty without one."""
    first = F.get(F.filter(groups(name), _is_region), 0)
    return F.coalesce(F.array_join(F.transform(F.split(first, ", "), lambda p: F.element_at(_region_map(), p)), "-"), F.lit(""))


def catalogue_regions(name: Column) -> Column:
    """Codes of a name of the other convention, ``Title (Date)(Publisher)(System)(Video)(Country)...``, where countries are codes; null for other names."""
    tail = F.regexp_extract(name, _DATED, 1)
    codes = F.array_distinct(F.array(*map(F.lit, sorted({c for v in REGIONS.values() for c in v.split("-")}))))
    country = F.get(F.filter(groups(tail), lambda g: g.rlike(r"^[A-Z]{2}(-[A-Z]{2})*$") & F.forall(F.split(g, "-"), lambda c: F.array_contains(codes, c))), 0)
    return F.when(name.rlike(_DATED), F.coalesce(country, F.lit("")))


def regions_of(name: Column) -> Column:
    """Region codes by either convention; empty without a region."""
    own = region_codes(name)
    return F.when(own != "", own).otherwise(F.coalesce(catalogue_regions(name), F.lit("")))


def languages(name: Column) -> Column:
    """Languages of all language groups, without variants; only well-formed ones."""
    found = F.flatten(F.transform(F.filter(groups(name), lambda g: g.rlike(_LANGUAGES)), lambda g: F.split(g, "[,+]")))
    return F.transform(found, lambda x: F.substring(x, 1, 2))


def version(name: Column) -> Column:
    """The last version token; versions compare as strings."""
    last = F.element_at(F.filter(groups(name), lambda g: g.rlike(_VERSION)), -1)
    return F.when(F.size(F.filter(groups(name), lambda g: g.rlike(_VERSION))) > 0, F.regexp_replace(last, "^(Rev |[vV]|Version )", ""))


def releases(name: Column) -> Column:
    return F.transform(F.filter(groups(name), lambda g: g.rlike(_RELEASE)), lambda g: F.regexp_extract(g, _RELEASE, 1))


def flags(name: Column) -> Column:
    """Whole flag groups: what is neither region, language, version, release nor medium."""
    return F.filter(groups(name), lambda g: ~(_is_region(g) | g.rlike(_LANGUAGES) | g.rlike(_VERSION) | g.rlike(_RELEASE) | g.rlike(_MEDIA)))


def flag_parts(name: Column) -> Column:
    return F.flatten(F.transform(flags(name), lambda g: F.split(g, ", ")))


def information(name: Column) -> Column:
    return F.struct(
        title(name).alias("title"), F.split(region_codes(name), "-").alias("regions"), languages(name).alias("languages"), F.get(releases(name), 0).alias("release"), flag_parts(name).alias("flags")
    )


def ignored(name: Column, comment: Column, arcade: Column, wanted_languages: Sequence[str], ignored_releases: Sequence[str], ignored_flags: Sequence[str]) -> Column:
    """Whether an entry is trimmed before the election.

    Languages only matter when some release or flag is ignored too, which the
    caller checks by leaving both lists empty.
    """
    if not ignored_releases and not ignored_flags:
        return F.lit(False)
    one_of = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    in_comment = F.exists(one_of(ignored_releases), lambda r: F.contains(F.coalesce(comment, F.lit("")), r))
    spoken = languages(name)
    foreign = (F.size(spoken) > 0) & ~F.arrays_overlap(spoken, one_of(wanted_languages)) if wanted_languages else F.lit(False)
    by_name = foreign | F.arrays_overlap(releases(name), one_of(ignored_releases)) | F.arrays_overlap(F.concat(flags(name), flag_parts(name)), one_of(ignored_flags))
    return F.when(arcade, in_comment).otherwise(F.coalesce(by_name, F.lit(False)))
