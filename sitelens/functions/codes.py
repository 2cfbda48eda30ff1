"""hreflang code lists and tag validation."""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.expr import browser_trim, let

# Two-letter language codes accepted in hreflang.  A longer tag is
# accepted through its first part, so only the first parts are listed.
LANGUAGES = tuple(
    """
    aa ab af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy
    da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht
    hu hy hz ia id ie ig ii ik in io is it iu ja jv jw ka kg ki kj kk kl km kn ko kr ks ku kv
    kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mo mr ms mt my na nb nd ne ng nl nn no
    nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn
    so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa
    wo xh yi yo za zh zu
    """.split()
)

# Common mistakes and the code that was probably meant.
TYPOS = {
    "en-uk": "en-gb",
    "jp": "ja",
    "cz": "cs",
    "sp": "es",
    "kr": "ko",
    "dk": "da",
    "gr": "el",
    "se": "sv",
    "br": "pt-br",
    "ua": "uk",
    "cn": "zh",
    "iw": "he",
    "in": "id",
    "zh-tw": "zh-hant",
    "zh-cn": "zh-hans",
}

# Region codes in use that ISO 3166-1 itself does not list.
EXTRA_REGIONS = ("EU", "XK")


@lru_cache(maxsize=1)
def iso_regions() -> tuple[str, ...]:
    """ISO 3166-1 alpha-2 codes from the public time-zone database, plus extras."""
    text = (resources.files("tzdata") / "zoneinfo" / "iso3166.tab").read_text("utf-8")
    rows = [line.split("\t")[0] for line in text.splitlines() if line and line[0] != "#"]
    return tuple(sorted({*rows, *EXTRA_REGIONS}))


def hreflang_verdict(
    tag: Column,
    languages: tuple[str, ...] = LANGUAGES,
    regions: tuple[str, ...] | None = None,
    typos: dict[str, str] | None = None,
) -> Column:
    """struct<valid,reason,typo> for one hreflang value.

    The three code lists are parameters; they are dimension-sized literals."""
    regions = regions or iso_regions()
    typo_map = F.create_map(*[F.lit(x) for kv in (typos or TYPOS).items() for x in kv])
    # The typo list is consulted first, so some real codes are reported as typos.

    def judge(t: Column) -> Column:
        language = F.substring_index(t, "-", 1)
        region = F.upper(F.regexp_extract(t, "^[^-]*-(.*)$", 1))
        typo = F.try_element_at(typo_map, t)
        reason = (
            F.when(t == "x-default", F.lit(None))
            .when(t == "", "hreflang value is empty")
            .when(
                typo.isNotNull(),
                F.concat(F.lit('"'), t, F.lit('" looks like a typo — did you mean "'), typo, F.lit('"?')),
            )
            .when(
                ~language.isin(*languages),
                F.concat(F.lit('"'), language, F.lit('" is not a valid ISO 639-1 language code')),
            )
            .when(
                (F.length(region) == 2) & ~region.isin(*regions),
                F.concat(F.lit('"'), region, F.lit('" is not a valid ISO 3166-1 region code')),
            )
        )
        return F.struct(
            reason.isNull().alias("valid"),
            reason.alias("reason"),
            F.when(~t.isin("x-default", ""), typo).alias("typo"),
        )

    return let(F.lower(browser_trim(tag)), judge)
