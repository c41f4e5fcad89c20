"""Endpoint text, port classes and address classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.dims import PORT_CLASS, lookup

# Special-purpose address blocks that are not globally reachable, as patterns.
PRIVATE_V4 = (r"^(0|10|127|24\d|25[0-5])\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.0\.[02]\.|^192\.168\."
              r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.")
PUBLIC_V4 = r"^192\.0\.0\.(9|10)$"
PRIVATE_V6 = (r"^::1?$|^64:ff9b:1:|^100::|^2001:(:|[01]?[0-9a-f]{1,2}:)|^2001:0?db8:|^2002:|^3fff:(:|0?[0-9a-f]{1,3}:)"
              r"|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:")
PUBLIC_V6 = r"^2001:1::[12]$|^2001:3:|^2001:4:112:|^2001:[23][0-9a-f]:"
V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def hostport(host: Column, port: Column) -> Column:
    text = port.cast("string")
    return F.when(F.instr(host, ":") > 0, F.concat(F.lit("["), host, F.lit("]:"), text)) \
        .otherwise(F.concat(host, F.lit(":"), text))


def port_class(port: Column) -> Column:
    return F.coalesce(lookup(PORT_CLASS, port), F.lit("nonstandard"))


def is_private(ip: Column) -> Column:
    """True for addresses that are not globally reachable; false for foreign text."""
    low = F.regexp_replace(F.lower(ip), r"^::ffff:(?=\d+\.)", "")
    v4 = low.rlike(V4) & low.rlike(PRIVATE_V4) & ~low.rlike(PUBLIC_V4)
    v6 = low.rlike(PRIVATE_V6) & ~low.rlike(PUBLIC_V6)
    return F.coalesce(F.when(F.instr(low, ":") > 0, v6).otherwise(v4), F.lit(False))
