"""The 34-column feature vector, one column expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil import dims

KEYS = ["capture_id", "session_id"]


def _one(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def feature_columns() -> dict[str, Column]:
    """Feature name to expression over the wide fact row plus ``codes``."""
    col = F.col
    hello = F.coalesce(col("server_hello_seen"), F.lit(False))
    shown = F.coalesce(col("present"), F.lit(False))
    known = hello & col("cipher_suite").isNotNull()
    out: dict[str, Column] = {}
    for p in ("SMTP", "IMAP", "POP3"):
        out[f"proto_{p.lower()}"] = _one(col("protocol") == p)
    for c in ("relay", "submission", "access", "nonstandard"):
        out[f"port_{c}"] = _one(col("port_class") == c)
    out["mode_ordinal"] = F.coalesce(dims.lookup({"starttls": 1.0, "implicit": 2.0}, col("mode")), F.lit(0.0))
    out["tls_version"] = F.when(hello, dims.version_ordinal(col("version"))).otherwise(0).cast("double")
    out["forward_secrecy"] = _one(known & col("forward_secrecy"))
    out["aead"] = _one(known & col("aead"))
    grade = F.coalesce(dims.lookup({"A": 0.0, "B": 1.0, "C": 2.0, "F": 3.0}, col("cipher_grade")), F.lit(2.0))
    out["cipher_grade"] = F.when(known, grade).when(hello, 0.0).otherwise(4.0)
    out["weak_dh_or_curve"] = _one(hello & F.coalesce(
        ((col("dh_bits") != 0) & (col("dh_bits") < 2048)), F.lit(False)) | (hello & col("used_group").isin(*dims.WEAK_GROUPS)))
    out["compression"] = _one(hello & (col("compression") != 0))
    out["downgrade_signal"] = _one(hello & (F.coalesce(col("downgrade_sentinel") != "", F.lit(False))
                                            | F.coalesce(col("fallback_scsv"), F.lit(False))))
    out["handshake_failed"] = _one(col("client_hello_seen") & (F.exists("alerts", lambda a: a["level"] == 2) | ~hello))
    out["cert_visible"] = _one(shown)
    out["cert_expired"] = _one(shown & (col("expired") | col("not_yet_valid")))
    out["cert_self_signed"] = _one(shown & col("self_signed"))
    out["cert_hostname_mismatch"] = _one(shown & (col("hostname_match") == F.lit(False)))
    out["cert_untrusted"] = _one(shown & (col("trusted") == F.lit(False)))
    bits = F.coalesce(col("leaf.key_bits"), F.lit(0))
    target = F.when(col("leaf.key_type").rlike("^(EC|Ed)"), 256.0).otherwise(2048.0)
    out["cert_key_weakness"] = F.when(~shown, 0.0).when(bits == 0, 1.0).otherwise(
        F.round(F.greatest(F.lit(0.0), 1.0 - bits / target), 3))
    out["cert_weak_sig"] = _one(shown & F.lower(col("leaf.signature_hash")).isin("md5", "sha1"))
    out["starttls_offered"] = _one(F.coalesce(col("starttls_offered"), F.lit(False)) | (col("mode") == "implicit"))
    out["strip_indicator"] = _one(F.size("strip_indicators") > 0)
    out["injection"] = _one(F.size("injection_indicators") > 0)
    out["cleartext_auth"] = _one(F.exists("auth_events", lambda e: e["secret_exposed"]))
    out["weak_auth"] = _one(F.exists("auth_events", lambda e: ~e["secret_exposed"]))
    size = F.greatest(col("cleartext_bytes"), F.lit(0)).cast("double")
    out["cleartext_data"] = F.round(F.least(F.log1p(size) / 12.0, F.lit(1.0)), 3)
    out["overlap_conflicts"] = F.least(F.greatest(col("overlap_conflicts"), F.lit(0)), F.lit(5)).cast("double") / 5.0
    for code in ("starttls_drop", "cert_change", "downgrade", "new_ja3s"):
        out[f"base_{code}"] = _one(F.array_contains("codes", code))
    return out


def features(facts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Session key plus the 34 features, in their fixed order."""
    if codes is None:
        base = facts.withColumn("codes", F.array().cast("array<string>"))
    else:
        base = facts.join(codes, KEYS, "left")
    columns = feature_columns()
    return base.select(*KEYS, *[columns[name].alias(name) for name in dims.FEATURES])


def as_vector(df: DataFrame) -> DataFrame:
    """Session key plus one array<double> in the fixed order."""
    return df.select(*KEYS, F.array(*dims.FEATURES).alias("features"))


def feature_groups(spark) -> DataFrame:
    rows = [(g, i, f, dims.FEATURE_REFERENCE.get(f, 0.0), dims.FEATURES.index(f))
            for i, (g, names) in enumerate(dims.FEATURE_GROUPS) for f in names]
    return dims.dimension(spark, rows, ["feature_group", "group_no", "feature", "reference", "position"])
