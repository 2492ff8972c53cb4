"""Which of a page's resources are left out, and why: in order scheme, kind, a user's hosts, trackers, adverts, address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions import urls as U
from pagewright.functions.addresses import fetch_refusal
from pagewright.functions.resolution import let


def decision(kind: Column, url: Column, custom: tuple[str, ...] = (), kinds: tuple[str, ...] = ("image", "font", "media"), trackers: bool = True, adverts: bool = True, guarded: bool = True) -> Column:
    """(blocked, matched, reason) of a resource; ``matched``: the name that decided it, if one did.

    The first reason that holds counts: 'scheme' (neither web nor of the browser itself), 'kind', 'custom', 'tracker',
    'advert', 'address' (of an internal host, or none). ``custom``: hosts of a user's own, with all below them.
    ``guarded``: whether schemes and addresses are judged.
    """

    def of(parts: Column) -> Column:
        name, where, labels = parts["host"], parts["where"], F.split(parts["host"], r"\.")

        def by_host(hosts: list[str] | tuple[str, ...]) -> Column:
            return F.coalesce(F.lit(None).cast("string"), *[F.when((name == h) | name.endswith(f".{h}"), h) for h in hosts])

        facebook = F.when(((name == "facebook.com") | name.endswith(".facebook.com")) & ((parts["path"] == "/tr") | parts["path"].startswith("/tr/")), "facebook.com/tr")
        tracker = F.coalesce(by_host(V.TRACKER_HOSTS), facebook, *[F.when(F.array_contains(labels, x), f"{x}.") for x in V.TRACKER_LABELS], *[F.when(F.contains(where, F.lit(p)), p) for p in V.TRACKER_PATHS])
        advert = F.coalesce(by_host(V.AD_HOSTS), *[F.when(F.array_contains(labels, x), f"{x}.") for x in V.AD_LABELS])
        own = by_host([h.lower().rstrip(".") for h in custom])
        inner = parts["scheme"].isin(*V.BROWSER_SCHEMES) & F.lit(guarded)

        def told(found: Column) -> Column:
            reason = (
                F.when(inner, None).when(F.lit(guarded) & ~parts["scheme"].isin("http", "https"), "scheme").when(kind.isin(*kinds), "kind").when(found["own"].isNotNull(), "custom")
                .when(found["tracker"].isNotNull(), "tracker").when(found["advert"].isNotNull(), "advert").when((name == "") | (F.lit(guarded) & fetch_refusal(url).isNotNull()), "address")
            )
            return let(reason, lambda r: F.struct(r.isNotNull().alias("blocked"), F.when(r == "custom", found["own"]).when(r == "tracker", found["tracker"]).when(r == "advert", found["advert"]).alias("matched"), r.alias("reason")))

        none = F.lit(None).cast("string")
        return let(F.struct(own.alias("own"), (tracker if trackers else none).alias("tracker"), (advert if adverts else none).alias("advert")), told)

    path = F.when(U.path(url) == "", "/").otherwise(U.path(url))
    query = F.when(U.query(url) == "", "").otherwise(F.concat(F.lit("?"), U.query(url)))
    return let(F.struct(U.scheme(url).alias("scheme"), U.host(url).alias("host"), path.alias("path"), F.concat(path, query).alias("where")), of)
