"""Content-addressed bundles: a document without asset bytes, its receipt, and its assets embedded or external.

A bundle's wire form is canonical JSON, so its digest names it. Cheap gates (size, digest) run natively before the
kernel parses anything; the comparison of document and envelope assets is kept in the kernel since the first
failure decides. External assets are only listed here: fetching them is the caller's affair.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical, joined
from ..sources.decode import Decoder, Rejected, decode_one, digests, loads
from . import schema as S

# Fixed values of profile 1.0.0.
VERSION, RAW, FIELD, ASSETS, ASSET_BYTES, BASE64, DEPTH, STRING, NODES = "1.0.0", 8 * 1024 * 1024, 5_600_000, 256, 4 * 1024 * 1024, 5_592_408, 128, 5_592_408, 1_000_000
IDENTIFIER, LONE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\Z"), re.compile(r"[\ud800-\udfff]")
KEYS = {"mediaType", "bundleVersion", "schemaVersion", "documentSha256", "document", "assets", "receipt"}
ASSET_KEYS = {"id", "sha256", "mediaType", "byteLength", "payload"}
#: The default only: bundles that are exchanged with other engines need the media type those use, given as a parameter.
MEDIA_TYPE = "application/vnd.struct+json"


class Refused(ValueError):
    def __init__(self, stage: str, code: str):
        super().__init__(f"bundle refused at {stage}: {code}")
        self.stage, self.code = stage, code


def create(document: dict, external: frozenset[str] = frozenset(), media_type: str = MEDIA_TYPE) -> bytes:
    """The bundle of a decoded document; assets named in external are referred to by their digest."""
    plain = document | {"assets": [{k: v for k, v in a.items() if k != "bytes"} for a in document["assets"]]}
    assets, total = [], 0
    for a in sorted(document["assets"], key=lambda a: a["id"]):
        if a["id"] not in external and "bytes" not in a:
            raise Refused("assets", "UNRESOLVED")
        size = len(base64.b64decode(a.get("bytes", "")))
        total += size
        if size > ASSET_BYTES or total > ASSET_BYTES:
            raise Refused("assets", "LIMIT")
        payload = {"kind": "external", "resourceId": "sha256:" + a["sha256"]} if a["id"] in external else {"kind": "embedded", "base64": a["bytes"]}
        assets.append({"id": a["id"], "sha256": a["sha256"], "mediaType": a["mediaType"], "byteLength": size, "payload": payload})
    if len(assets) > ASSETS:
        raise Refused("assets", "LIMIT")
    body = canonical(plain)
    envelope = {"mediaType": media_type, "bundleVersion": VERSION, "schemaVersion": document["schemaVersion"], "documentSha256": hashlib.sha256(body.encode()).hexdigest(), "assets": assets, "receipt": document["receipt"]}
    texts = {k: canonical(v) for k, v in envelope.items()} | {"document": body}  # each field once, measured as it stands
    out = joined(texts).encode()
    if len(out) > RAW or any(len(t) > FIELD or len(t) * 4 > FIELD and len(t.encode()) > FIELD for t in texts.values()):
        raise Refused("canonical", "LIMIT")
    return out


def _bounded(value, depth: int = 0, left: list[int] | None = None) -> None:
    """Nodes, depth, bytes of texts and keys; numbers must be finite and whole ones safe, texts without lone surrogates."""
    left = left if left is not None else [NODES]
    left[0] -= 1
    if depth > DEPTH or left[0] < 0:
        raise Refused("canonical", "LIMIT")
    if isinstance(value, (int, float)) and (not math.isfinite(value) or value == int(value) and abs(value) > 2**53 - 1):
        raise Refused("canonical", "TYPE")
    for x in [value] if isinstance(value, str) else value if isinstance(value, dict) else ():
        if len(x.encode("utf-8", "surrogatepass")) > STRING:
            raise Refused("canonical", "LIMIT")
        if LONE.search(x):
            raise Refused("canonical", "TYPE")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _bounded(v, depth + 1, left)


def verify(raw: bytes, expected: str | None = None, media_type: str = MEDIA_TYPE) -> dict:
    """The envelope of a bundle that holds, with `external`, the ids of assets still to be fetched; else Refused."""
    if len(raw) > RAW:
        raise Refused("input", "LIMIT")
    if expected is not None and hashlib.sha256(raw).hexdigest() != expected:
        raise Refused("digest", "MISMATCH")
    try:
        envelope = loads(raw.decode())
    except (ValueError, RecursionError):
        raise Refused("canonical", "SYNTAX") from None
    _bounded(envelope)
    if not isinstance(envelope, dict) or set(envelope) != KEYS or envelope["mediaType"] != media_type or envelope["bundleVersion"] != VERSION or not isinstance(envelope["assets"], list):
        raise Refused("canonical", "TYPE")
    try:
        document = Decoder()(S.DOCUMENT, envelope["document"], "$")
    except Rejected:
        raise Refused("canonical", "TYPE") from None
    body = canonical(envelope["document"])
    if (
        any("bytes" in a for a in document["assets"]) or envelope["schemaVersion"] != document["schemaVersion"] or hashlib.sha256(body.encode()).hexdigest() != envelope["documentSha256"]
        or canonical(envelope["receipt"]) != canonical(document["receipt"]) or document["receipt"]["generatedSha256"] not in digests(document)
    ):
        raise Refused("canonical", "TYPE")
    for a in envelope["assets"]:
        if not isinstance(a, dict) or set(a) != ASSET_KEYS or not isinstance(a["payload"], dict) or a["payload"].get("kind") not in ("embedded", "external") or set(a["payload"]) - {"kind", "base64", "resourceId"} or len(a["payload"]) != 2:
            raise Refused("canonical", "TYPE")
    ids = [a["id"] for a in envelope["assets"]]
    texts = {k: canonical(v) for k, v in envelope.items() if k != "document"} | {"document": body}
    if document != envelope["document"] or ids != sorted(map(str, ids)) or joined(texts).encode() != raw:
        raise Refused("canonical", "NONCANONICAL")
    if any(len(t.encode()) > FIELD for t in texts.values()):
        raise Refused("canonical", "LIMIT")
    wanted, total, external = {a["id"]: a for a in document["assets"]}, 0, []
    if len(ids) > ASSETS:
        raise Refused("assets", "LIMIT")
    if set(ids) != set(wanted) or len(set(ids)) < len(ids):
        raise Refused("assets", "SET")
    for a in envelope["assets"]:
        own, size = wanted[a["id"]], a["byteLength"]
        if own["sha256"] != a["sha256"] or own["mediaType"] != a["mediaType"] or not isinstance(size, int) or size < 0:
            raise Refused("assets", "METADATA")
        total += size
        if size > ASSET_BYTES or total > ASSET_BYTES:
            raise Refused("assets", "LIMIT")
        if a["payload"]["kind"] == "external":
            if a["payload"].get("resourceId") != "sha256:" + a["sha256"]:
                raise Refused("assets", "METADATA")
            external.append(a["id"])
            continue
        text = a["payload"].get("base64")
        if not isinstance(text, str) or len(text) > BASE64:
            raise Refused("assets", "LIMIT" if isinstance(text, str) else "SHAPE")
        try:
            data = base64.b64decode(text, validate=True)
        except ValueError:
            raise Refused("assets", "BASE64") from None
        if base64.b64encode(data).decode() != text or len(data) != size:
            raise Refused("assets", "BASE64")
        if hashlib.sha256(data).hexdigest() != a["sha256"]:
            raise Refused("assets", "DIGEST")
    return envelope | {"external": external}


def resolved(raw: bytes, fetched: dict[str, bytes], expected: str | None = None, media_type: str = MEDIA_TYPE) -> dict[str, bytes]:
    """Bytes of all assets of a bundle, external ones from what has been fetched, by id; all must fit their digests."""
    envelope = verify(raw, expected, media_type)
    out = {}
    for a in envelope["assets"]:
        data = base64.b64decode(a["payload"]["base64"]) if a["payload"]["kind"] == "embedded" else fetched.get(a["id"])
        if data is None:
            raise Refused("assets", "UNRESOLVED")
        if len(data) != a["byteLength"]:
            raise Refused("resolve", "LENGTH")
        if hashlib.sha256(data).hexdigest() != a["sha256"]:
            raise Refused("resolve", "DIGEST")
        out[a["id"]] = data
    return out


def _refusal(make) -> tuple:
    try:
        return None, None, make()
    except Refused as e:
        return e.stage, e.code, None


def bundled(decoded: DataFrame, media_type: str = MEDIA_TYPE) -> DataFrame:
    """doc_key, stage, code, bundle (binary) and bundle_sha256 of decoded documents; stage and code say why there is none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_refusal(lambda raw=raw: create(decode_one(raw)[0], media_type=media_type)) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.binary())))], names=["doc_key", "stage", "code", "bundle"])

    kind = dict(decoded.dtypes)["doc_key"]
    out = decoded.filter("code is null").select("doc_key", "encoded").mapInArrow(run, f"doc_key {kind}, stage string, code string, bundle binary")
    return out.withColumn("bundle_sha256", F.sha2("bundle", 256))


def verified(bundles: DataFrame, key: str = "doc_key", raw: str = "bundle", expected: str | None = None, media_type: str = MEDIA_TYPE) -> DataFrame:
    """key, stage, code (null where the bundle holds) and document, its canonical text.

    Bundles that are too large, or that differ from the expected digest (a column), never reach the kernel.
    """
    too_large = F.octet_length(raw) > RAW
    differs = F.sha2(raw, 256) != F.col(expected) if expected else F.lit(False)
    gate = bundles.select(F.col(key).alias("doc_key"), F.col(raw).alias("raw"), F.when(too_large, "input").when(differs, "digest").alias("stage"), F.when(too_large, "LIMIT").when(differs, "MISMATCH").alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_refusal(lambda data=data: canonical(verify(data, None, media_type)["document"])) for data in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))], names=["doc_key", "stage", "code", "document"])

    shape = f"doc_key {dict(gate.dtypes)['doc_key']}, stage string, code string, document string"
    passed = gate.filter("stage is null").select("doc_key", "raw").mapInArrow(run, shape)
    return passed.unionByName(gate.filter("stage is not null").select("doc_key", "stage", "code", F.lit(None).cast("string").alias("document"))).withColumnRenamed("doc_key", key)


# -- resolver policies
def policy_digest(policy: dict, domain: bytes) -> tuple[str, str]:
    """(canonical text, digest in its domain) of a resolver policy; Refused('resolve', 'POLICY') if it isn't one."""
    closed = {
        "https": ({"kind", "endpointMapId", "allowedEndpointIds", "redirects", "maxRedirects", "denyPrivateNetworks", "serializedLocators"}, {"denyPrivateNetworks": True, "serializedLocators": False}),
        "filesystem": ({"kind", "rootCapabilityId", "allowAbsolute", "allowTraversal", "allowSymlinks"}, {"allowAbsolute": False, "allowTraversal": False, "allowSymlinks": False}),
        "content-addressed": ({"kind", "storeId", "algorithm"}, {"algorithm": "sha256"}),
    }
    check = Decoder()
    try:
        check.shape(policy, "$", ("protocolVersion", "profileId", "profileVersion", "maxConcurrent", "transport"), ())
        t = check.fields(policy["transport"], "$.transport")
        keys, fixed = closed.get(t.get("kind"), (None, {}))
        if keys != set(t) or policy["protocolVersion"] != "1.0.0" or any(t[k] is not v and t[k] != v for k, v in fixed.items()):
            raise Rejected("ENUM", "$.transport", "not a closed policy")
        for name in ("profileId", "profileVersion"):
            check.is_id(policy[name], name)
        check.is_int(policy["maxConcurrent"], "maxConcurrent", 0)
        for name in {"endpointMapId", "rootCapabilityId", "storeId"} & keys:
            check.is_id(t[name], name)
        if t["kind"] == "https":
            check.is_list(t["allowedEndpointIds"], "allowedEndpointIds", S.ID, "endpoint")
            check.is_int(t["maxRedirects"], "maxRedirects", 0)
            check.is_enum(t["redirects"], "redirects", ("deny", "same-origin"))
            t = t | {"allowedEndpointIds": sorted(t["allowedEndpointIds"])}
    except Rejected:
        raise Refused("resolve", "POLICY") from None
    text = canonical(json.loads(json.dumps(policy | {"transport": t})))
    return text, hashlib.sha256(domain + b"\0" + text.encode()).hexdigest()


def fetch_receipt(policy: dict, policy_sha256: str, expected: dict, receipt: dict, domain: bytes) -> dict:
    """The receipt of a fetch, if it names the policy, the expected asset and a way that the policy allows.

    expected: id, sha256, mediaType, byteLength of the asset. Refused('resolve', 'SHAPE') where keys are missing or
    unknown, Refused('resolve', 'VALUE') where a value differs. It tells nothing about the bytes themselves.
    """
    def closed(value, required: str, optional: str = "") -> dict:
        if not isinstance(value, dict) or set(required.split()) - set(value) or set(value) - set(required.split()) - set(optional.split()):
            raise Refused("resolve", "SHAPE")
        return value

    def holds(test) -> None:
        if not test:
            raise Refused("resolve", "VALUE")

    named = lambda v: isinstance(v, str) and bool(IDENTIFIER.match(v))
    length = lambda v: type(v) in (int, float) and v == int(v) and 0 <= v < 2**53
    text, own = policy_digest(policy, domain)
    way = json.loads(text)["transport"]
    holds(policy_sha256 == own)
    closed(expected, "id sha256 mediaType byteLength")
    holds(all(isinstance(expected[k], str) and expected[k] for k in ("id", "mediaType")))
    holds(isinstance(expected["sha256"], str) and re.fullmatch(r"[0-9a-f]{64}", expected["sha256"]) and length(expected["byteLength"]))
    closed(receipt, "protocolVersion resourceId transportReceipt", "declaredByteLength")
    holds(receipt["protocolVersion"] == VERSION and receipt["resourceId"] == "sha256:" + expected["sha256"])
    if "declaredByteLength" in receipt:
        holds(length(receipt["declaredByteLength"]) and receipt["declaredByteLength"] == expected["byteLength"])
    went = receipt["transportReceipt"]
    if not isinstance(went, dict):
        raise Refused("resolve", "SHAPE")
    holds(went.get("policySha256") == own and went.get("kind") == way["kind"])
    place = {"https": "endpointMapId", "filesystem": "rootCapabilityId", "content-addressed": "storeId"}[way["kind"]]
    closed(went, f"kind policySha256 {place}" + " endpointId redirectEndpointIds" * (way["kind"] == "https"))
    holds(named(went[place]) and went[place] == way[place])
    if way["kind"] == "https":
        hops, allowed = went["redirectEndpointIds"], way["allowedEndpointIds"]
        holds(named(went["endpointId"]) and went["endpointId"] in allowed)
        if not isinstance(hops, list):
            raise Refused("resolve", "SHAPE")
        holds(all(named(h) and h in allowed for h in hops) and len(hops) <= (0 if way["redirects"] == "deny" else way["maxRedirects"]))
    return receipt
