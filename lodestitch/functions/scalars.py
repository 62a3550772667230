"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of edge confidence, relation kind, file role and policy scope (fixed values).
CONFIDENCE_WEIGHT = {"certain": 1.0, "likely": 0.6, "possible": 0.3}
CONFIDENCE_RANK = {"possible": 1, "likely": 2, "certain": 3}
RELATION_WEIGHT = {
    1.0: "call render extend dispatches registered_handler produces_lifecycle produces_lifecycle_via lifecycle_listener"
    " produces_job produces_job_via job_handler injects provides handles_route handles_graphql",
    0.9: "invokes_graphql reads_resource writes_resource member_call member_candidate name_candidate",
    0.8: "acquires_resource reads_env reads_config checks_flag calls_host",
    0.75: "import reexport",
    0.7: "decorated_by emits listens",
    0.65: "accepts_contract returns_contract references_contract",
    0.6: "imports_types imports_package_types contains_event",
    0.55: "declares_contract",
}
ROLE_PENALTY = {
    "production": 1.0, "unknown": 0.75, "documentation": 0.4, "test": 0.3, "fixture": 0.2, "generated": 0.1,
}
POLICY_PENALTY = {"runtime": 1.0, "tooling": 0.45, "documentation": 0.4, "test": 0.3, "generated": 0.1}


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a fixed table; ``default`` for other keys and null."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def confidence_weight(c: Column) -> Column:
    return lookup(c, CONFIDENCE_WEIGHT, 0.0)


def confidence_rank(c: Column) -> Column:
    return lookup(c, CONFIDENCE_RANK, 0)


def confidence_meet(a: Column, b: Column) -> Column:
    """The lower of two confidences."""
    return F.when(confidence_rank(a) <= confidence_rank(b), a).otherwise(b)


def relation_weight(kind: Column) -> Column:
    return lookup(kind, {k: w for w, kinds in RELATION_WEIGHT.items() for k in kinds.split()}, 0.5)


def role_penalty(role: Column) -> Column:
    """Penalty of a file role; none counts as production."""
    return F.when(role.isNull(), 1.0).otherwise(lookup(role, ROLE_PENALTY, 0.0))


def policy_penalty(scope: Column) -> Column:
    return lookup(scope, POLICY_PENALTY, 1.0)


def effective_role(file_role: Column, scope_role: Column) -> Column:
    """Test, fixture and generated files stay what they are; others take the scope's role if there is one."""
    return F.when(file_role.isin("test", "fixture", "generated"), file_role).otherwise(F.coalesce(scope_role, file_role))


def distance_decay(depth: Column) -> Column:
    return F.pow(F.lit(0.75), depth - 1)


def hub_damping(degree: Column) -> Column:
    return 1.0 / F.log2(degree + 2)


def round_score(x: Column) -> Column:
    return F.round(x, 6)


def identifier_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits, underscore and dollar."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_$]+)"), 1)


def search_terms(text: Column) -> Column:
    """Lower-case terms of a text: runs of letters, digits, underscore and dollar."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_$]+)"), 1)


def fts_query(text: Column) -> Column:
    """Terms quoted and joined with OR."""
    terms = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_$]+)"), 1)
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def semantic_tokens(text: Column) -> Column:
    """Lower-case tokens of more than one byte."""
    return F.filter(F.transform(identifier_tokens(text), F.lower), lambda t: F.octet_length(t) > 1)


def lexical_relevance(query: Column, name: Column, body: Column) -> Column:
    """min(1, (matched tokens + 4 if the name is the query) / tokens); null if nothing matches."""
    tokens = F.array_distinct(semantic_tokens(query))
    words = semantic_tokens(F.concat_ws(" ", name, body))
    matches = F.size(F.array_intersect(tokens, words))
    exact = F.when(F.lower(name) == F.lower(query), 4).otherwise(0)
    score = F.least(F.lit(1.0), (matches + exact) / F.greatest(F.size(tokens), F.lit(1)))
    return F.when(score > 0, score)


def repository_area(path: Column) -> Column:
    """The area of a repository a path belongs to: its dependency, its package, app or service, its folder in src,
    else its top folder; "." for files at the top."""
    parts = F.split(path, "/")
    top = F.get(parts, F.lit(0))
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    scoped = second.startswith("@") & third.isNotNull()
    dependency = F.concat_ws("/", top, second, F.when(scoped, third))
    return (
        F.when(F.size(parts) < 2, ".")
        .when(top == "node_modules", dependency)
        .when(top.isin("packages", "apps", "services") & (F.size(parts) > 2), F.concat_ws("/", top, second))
        .when((top == "src") & (F.size(parts) > 2), F.concat_ws("/", top, second))
        .otherwise(top)
    )


def trimmed_route(path: Column) -> Column:
    """A route with one leading slash and none at the end."""
    return F.concat(F.lit("/"), F.trim(path, F.lit("/")))


def join_route(prefix: Column, path: Column) -> Column:
    """Controller prefix and method path as one route."""
    parts = F.filter(F.array(F.trim(prefix, F.lit("/")), F.trim(path, F.lit("/"))), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and brackets; null if there is no scheme."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(rest, r"^.*@", "")
    plain = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(host, r":.*$", ""))
    return F.when(plain != "", F.lower(plain))


def mutation_resource(name: Column) -> tuple[Column, Column]:
    """(event, resource) of a create, update or delete operation name; null for others."""
    verb = F.regexp_extract(name, r"^(create|update|delete)[A-Z]", 1)
    resource = F.regexp_extract(name, r"^(?:create|update|delete)([A-Z]\w*)$", 1)
    event = F.when(verb == "create", "created").when(verb == "update", "updated").when(verb == "delete", "deleted")
    is_one = resource != ""
    lower_first = F.concat(F.lower(F.substring(resource, 1, 1)), F.expr("''"), F.substring(resource, 2, 1_000_000))
    return F.when(is_one, event), F.when(is_one, lower_first)


def holder_resource(name: Column) -> Column:
    """Resource a repository, repo or model object holds; null if the name is none."""
    stem = F.regexp_extract(name, r"(?i)^(\w+?)(?:repository|repo|model)$", 1)
    return F.when(stem != "", stem)


def package_name(request: Column) -> Column:
    """Package of a bare module specifier; null for relative, absolute and scheme-prefixed ones."""
    bare = ~request.rlike(r"^(?:\.{0,2}/|\.{1,2}$|[a-z]+:|#)")
    return F.when(bare & (request != ""), F.regexp_extract(request, r"^(@[^/]+/[^/]+|[^/]+)", 1))


def line_excerpt(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, both inclusive and counted from 1; null if the range is not in the text."""
    lines = F.split(text, "\n")
    ok = (first >= 1) & (last >= first) & (last <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n"))


def truncated_utf8(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends at a character boundary."""
    raw = F.encode(text, "utf-8")
    # a cut inside a character leaves at most three bytes of it
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - k)) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def digest(*columns: Column) -> Column:
    """SHA-256 of the values joined with a NUL, null as an empty string."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def encoded_key(text: Column) -> Column:
    """Percent-encoding of every byte that is not a letter, digit, dash, underscore, dot or tilde."""
    hexed = F.hex(F.encode(text, "utf-8"))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), 1)
    plain = "2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]"
    return F.array_join(
        F.transform(pairs, lambda p: F.when(p.rlike(f"^(?:{plain})$"), F.decode(F.unhex(p), "utf-8")).otherwise(F.concat(F.lit("%"), p))), ""
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length; null for a zero vector or another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def set_digest(*columns: Column) -> Column:
    """Aggregate: digest of a set of rows that does not depend on their order.

    The sum of 48-bit prefixes of the rows' digests, and the count, both exact, so partial aggregation works and no
    group is gathered.
    """
    row = F.conv(F.substring(F.sha2(F.concat_ws("\0", *columns), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(row).cast("string")), 256)
