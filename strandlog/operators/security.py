"""Capability tokens: who may do what on which resource, and what was revoked."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.codec import verify_ed25519

TOKEN_DAYS, ISSUER_DAYS = 7, 365


class Denied(PermissionError):
    """``reason`` is malformed, expired, not_yet_valid, bad_signature, revoked or insufficient_permissions."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def match_resource(granted: str, wanted: str) -> bool:
    """Equal, or the grant ends in ``*`` and what stands before is a prefix."""
    return granted == wanted or (granted.endswith("*") and wanted.startswith(granted[:-1]))


def match_action(granted: str, wanted: str) -> bool:
    return granted in ("*", wanted)


def resource_matches(granted: Column, wanted: Column) -> Column:
    head = F.substring(granted, F.lit(1), F.greatest(F.length(granted) - 1, F.lit(0)))
    return (granted == wanted) | (granted.endswith("*") & wanted.startswith(head))


def action_matches(granted: Column, wanted: Column) -> Column:
    return (granted == "*") | (granted == wanted)


def canonical_claims(claims: dict) -> bytes:
    """The bytes that are signed and digested: JSON with sorted keys, without the signature."""
    return json.dumps({k: v for k, v in claims.items() if k != "sig"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def token_id(claims: dict) -> str:
    import base64
    import hashlib

    return base64.urlsafe_b64encode(hashlib.sha256(canonical_claims(claims)).digest()).rstrip(b"=").decode()


@dataclass
class Revocations:
    """Revoked tokens and issuers; entries end by themselves when no valid token can be left."""

    tokens: dict[str, float] = field(default_factory=dict)
    issuers: dict[str, float] = field(default_factory=dict)

    def revoke(self, token: str, now: float | None = None, days: float = TOKEN_DAYS) -> None:
        self.tokens[token] = (time.time() if now is None else now) + days * 86400

    def revoke_issuer(self, issuer: str, now: float | None = None) -> None:
        self.issuers[issuer] = (time.time() if now is None else now) + ISSUER_DAYS * 86400

    def is_revoked(self, token: str, now: float | None = None) -> bool:
        return self.tokens.get(token, 0) > (time.time() if now is None else now)

    def is_issuer_revoked(self, issuer: str, now: float | None = None) -> bool:
        return self.issuers.get(issuer, 0) > (time.time() if now is None else now)

    def all(self) -> dict[str, list[str]]:
        return {"tokens": sorted(self.tokens), "issuers": sorted(self.issuers)}

    def clean(self, now: float) -> None:
        self.tokens = {k: v for k, v in self.tokens.items() if v > now}
        self.issuers = {k: v for k, v in self.issuers.items() if v > now}

    def clear(self) -> None:
        self.tokens.clear()
        self.issuers.clear()


def verify(token: str | bytes, public_key: bytes, now: float | None = None, revocations: Revocations | None = None) -> dict:
    """The claims of a good token, given as JSON with a hex ``sig``; else ``Denied``.

    Checked in this order: form, ``exp`` after now, ``nbf`` not after now, signature, revocation.
    """
    now = time.time() if now is None else now
    try:
        claims = json.loads(token)
        expires, signature = float(claims["exp"]), bytes.fromhex(claims["sig"])
    except (ValueError, KeyError, TypeError) as e:
        raise Denied("malformed") from e
    if expires <= now:
        raise Denied("expired")
    if float(claims.get("nbf") or 0) > now:
        raise Denied("not_yet_valid")
    if not verify_ed25519(canonical_claims(claims), signature, public_key):
        raise Denied("bad_signature")
    if revocations and (revocations.is_revoked(token_id(claims), now) or revocations.is_issuer_revoked(claims.get("iss", ""), now)):
        raise Denied("revoked")
    return claims


def check_permission(grants: Iterable[dict], resource: str, action: str) -> dict:
    """The first grant ``{"with": resource, "can": action}`` that matches."""
    for g in grants:
        if match_resource(g.get("with", ""), resource) and match_action(g.get("can", ""), action):
            return g
    raise Denied("insufficient_permissions")


def authorize(token: str | bytes, public_key: bytes, resource: str, action: str, now: float | None = None, revocations: Revocations | None = None) -> dict:
    claims = verify(token, public_key, now, revocations)
    check_permission(claims.get("att") or [], resource, action)
    return claims


def authorized(requests: DataFrame, grants: list[tuple[str, str]]) -> DataFrame:
    """``requests`` (columns resource, action) with ``allowed`` under a token's grants: one projection."""
    ok = F.lit(False)
    for resource, action in grants:
        ok = ok | (resource_matches(F.lit(resource), F.col("resource")) & action_matches(F.lit(action), F.col("action")))
    return requests.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def token_states(tokens: DataFrame, now: int, revoked: DataFrame | None = None) -> DataFrame:
    """``tokens`` (token_id, iss, exp, nbf in seconds) with ``state``: expired, not_yet_valid, revoked or valid.

    ``revoked`` has ``kind`` (token or issuer) and ``value``.
    """
    out = tokens
    hit = F.lit(False)
    if revoked is not None:
        t = revoked.where("kind = 'token'").select(F.col("value").alias("__t")).distinct()
        i = revoked.where("kind = 'issuer'").select(F.col("value").alias("__i")).distinct()
        out = out.join(t, F.col("token_id") == F.col("__t"), "left").join(i, F.col("iss") == F.col("__i"), "left")
        hit = F.col("__t").isNotNull() | F.col("__i").isNotNull()
    state = F.when(F.coalesce(F.col("exp") <= now, F.lit(True)), "expired").when(F.col("nbf") > now, "not_yet_valid").when(hit, "revoked").otherwise("valid")
    return out.withColumn("state", state).drop("__t", "__i")
