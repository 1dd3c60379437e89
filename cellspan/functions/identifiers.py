"""Identifier normalisers and classifiers as Column expressions; no Python runs for a row except for IP addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, and call-type labels.
NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a", "-", "--", "---", "<na>", "nat")
CALL_TYPE_LABELS = {
    "incoming": "Incoming Voice Call",
    "outgoing": "Outgoing Voice Call",
    "smsin": "Incoming SMS",
    "smsout": "Outgoing SMS",
    "sms": "SMS Event",
}
# operators' labels of each call type.
CALL_TYPES = {
    "outgoing": ("a_out", "moc", "mo", "out", "outgoing", "outgoing_call", "v_out", "vdo_out", "voice_out"),
    "incoming": ("a_in", "mtc", "mt", "in", "incoming", "incoming_call", "v_in", "vdo_in", "voice_in"),
    "smsin": ("a2p_smsin", "p2p_smsin", "smt", "smsin", "sms_in", "sms_mt", "incoming_sms"),
    "smsout": ("p2pout", "p2aout", "p2p_smsout", "smo", "smsout", "sms_out", "sms_mo", "outgoing_sms"),
    "sms": ("sms", "sms_generic"),
}
#: A service header such as AB-BANKXX-S.
SENDER_PATTERN = "(?i)^[A-Z]{2}-[A-Z0-9][A-Z0-9-]{2,}-[A-Z]$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Trimmed text without quotes at its ends; null stays null."""
    return F.btrim(F.trim(col(c).cast("string")), F.lit("'\""))


def text(c: Column | str) -> Column:
    """Trimmed text, null as the empty string (which counts as a value)."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit("")))


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def without_null_tokens(c: Column | str) -> Column:
    t = clean(c)
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def digits(c: Column | str) -> Column:
    """Digits of a number's text; a trailing ``.0`` of a number read as a float is not part of it."""
    return F.regexp_replace(F.regexp_replace(text(c), r"^(\d+)\.0$", "$1"), r"\D", "")


def msisdn(c: Column | str) -> Column:
    """Ten digits from 6-9 after a country or trunk prefix is taken off, else null."""
    d = digits(c)
    d = F.when(d.rlike(r"^91\d{10}$"), F.substring(d, 3, 10)).when(d.rlike(r"^0\d{10}$"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(d.rlike(r"^[6-9]\d{9}$"), d)


def party_key(c: Column | str) -> Column:
    """Mobile number if it is one, else its digits."""
    return F.coalesce(msisdn(c), digits(c))


def loose_number(c: Column | str) -> Column:
    """Last ten digits of at least ten, else null: the looser key of cross-target comparison."""
    d = digits(c)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def contact_key(c: Column | str) -> Column:
    """Last ten digits of a prefixed number, else digits, else the text."""
    d = digits(c)
    return (
        F.when(d.rlike(r"^(91\d{10}|0\d{10})$"), F.right(d, F.lit(10))).when(d != "", d).otherwise(text(c))
    )


def imei(c: Column | str) -> Column:
    """15 or 16 digits, else the empty string."""
    d = digits(c)
    return F.when(F.length(d).isin(15, 16), d).otherwise("")


def imsi(c: Column | str) -> Column:
    """14 to 16 digits, else the empty string."""
    d = digits(c)
    return F.when(F.length(d).between(14, 16), d).otherwise("")


def loose_imei(c: Column | str) -> Column:
    """First 15 digits of 15 or more, 14 digits as they are, else null: the key of cross-target comparison."""
    d = digits(c)
    return F.when(F.length(d) >= 15, F.left(d, F.lit(15))).when(F.length(d) == 14, d)


def loose_imsi(c: Column | str) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 10, d)


def device_family(c: Column | str) -> Column:
    """First 14 digits of 14 to 16, else the empty string."""
    d = digits(c)
    return F.when(F.length(d).between(14, 16), F.left(d, F.lit(14))).otherwise("")


def device_key(c: Column | str) -> Column:
    """First 14 digits of 15 or 16, else the digits, else the text."""
    d = digits(c)
    return F.when(F.length(d).isin(15, 16), F.left(d, F.lit(14))).when(d != "", d).otherwise(clean(c))


def luhn_valid(c: Column | str) -> Column:
    """15 digits with a right check digit."""
    d = digits(c)
    return (F.length(d) == 15) & F.call_function("luhn_check", d)


def imei_status(c: Column | str) -> Column:
    d = digits(c)
    return (
        F.when(luhn_valid(c), "VALID_IMEI")
        .when(F.length(d) == 15, "INVALID_IMEI")
        .when(F.length(d) == 16, "IMEISV")
        .otherwise("NON_STANDARD")
    )


def identifier_kind(c: Column | str) -> Column:
    n = F.length(digits(c))
    return F.when(n == 14, "BASE14").when(n == 15, "IMEI15").when(n == 16, "IMEISV16").otherwise("UNKNOWN")


def match_relation(query: Column | str, observed: Column | str) -> Column:
    """How an observed device identifier relates to the one asked for."""
    q, o = digits(query), digits(observed)
    family = F.left(q, F.lit(14)) == F.left(o, F.lit(14))
    return (
        F.when((q == "") | (F.length(q) < 14), "UNAVAILABLE")
        .when(o == "", "REPORT_SCOPE")
        .when(q == o, "EXACT")
        .when(family & ((F.length(q) == 14) | (F.length(o) == 14)), "BASE14_MATCH")
        .when(family, "SAME_BASE14")
        .otherwise("UNAVAILABLE")
    )


def subscriber_kind(c: Column | str) -> Column:
    """Value and type of a subscriber id: a mobile number, another number of 12 to 16 digits, a user id, or missing."""
    d, t = digits(c), text(c)
    mobile = msisdn(c)
    numeric = t.rlike(r"^\d{12,16}$")
    value = F.when(mobile.isNotNull(), mobile).when(numeric, d).otherwise(t)
    kind = F.when(t == "", "MISSING").when(mobile.isNotNull(), "MSISDN").when(numeric, "NUMERIC_SUBSCRIBER_ID").otherwise("USER_ID")
    return F.struct(value.alias("value"), kind.alias("kind"))


def session_identifier(c: Column | str) -> Column:
    t = text(c)
    return (
        F.when(t.rlike(r"^[6-9]\d{9}$"), "MSISDN")
        .when(t.rlike(r"^\d{12,16}$"), "NON_STANDARD_SUBSCRIBER_ID")
        .otherwise("INVALID_OR_UNVERIFIED")
    )


def contact_category(c: Column | str) -> Column:
    """human_mobile, service_sender_id, short_code or unknown_contact."""
    t = F.coalesce(clean(c), F.lit(""))
    compact = F.regexp_replace(t, "[ -]", "")
    return (
        F.when(t == "", "unknown_contact")
        .when(t.rlike(SENDER_PATTERN), "service_sender_id")
        .when(compact.rlike(r"^\d{1,6}$"), "short_code")
        .when(compact.rlike(r"^\d{7,15}$"), "human_mobile")
        .when(t.rlike(r"\p{L}"), "service_sender_id")
        .otherwise("unknown_contact")
    )


def call_type(c: Column | str) -> Column:
    return F.lower(text(c))


def call_meaning(c: Column | str, blank: str = "Missing / Blank Call Type") -> Column:
    t = call_type(c)
    out = F.when(t == "", blank)
    for k, v in CALL_TYPE_LABELS.items():
        out = out.when(t == k, v)
    return out.otherwise("Other / Unclassified Operator Event")


def canonical_call_type(raw: Column | str, service: Column | str | None = None) -> Column:
    """Call type from an operator's label: by the table of labels, else by the words in it.

    A service of SMS makes a voice label an SMS of the same direction. A label without a direction stays as it is.
    """
    t = F.regexp_replace(F.regexp_replace(call_type(raw), "[^a-z0-9]+", "_"), "^_|_$", "")
    s = call_type(service) if service is not None else F.lit("")
    inward = t.rlike("(^|_)(in|mt|mtc|incoming|term|terminating|received?)(_|$)|smsin")
    outward = t.rlike("(^|_)(out|mo|moc|outgoing|orig|originating|sent|dialled)(_|$)|smsout")
    guessed = F.when(inward & t.contains("sms"), "smsin").when(outward & t.contains("sms"), "smsout").when(t.contains("sms"), "sms")
    guessed = guessed.when(inward, "incoming").when(outward, "outgoing").otherwise(call_type(raw))
    out = guessed
    for kind, labels in CALL_TYPES.items():
        out = F.when(t.isin(*labels), kind).otherwise(out)
    by_service = F.when(out == "incoming", "smsin").when(out == "outgoing", "smsout").when(out.startswith("sms"), out).otherwise("sms")
    return F.when(s.contains("sms"), by_service).otherwise(out)


def is_incoming_voice(c: Column | str) -> Column:
    return call_type(c).isin("incoming", "mtc", "a_in")


def is_outgoing_voice(c: Column | str) -> Column:
    return call_type(c).isin("outgoing", "moc", "a_out")


def is_sms(c: Column | str) -> Column:
    return call_type(c).contains("sms")


def valid_cell(c: Column | str) -> Column:
    """A cell id that names a cell: no placeholder, no broken separator, at least six digits."""
    t = F.coalesce(clean(c), F.lit(""))
    return (
        ~F.lower(t).isin(*NULL_TOKENS)
        & ~t.contains("--")
        & ~t.endswith("-")
        & (F.length(F.regexp_replace(t, r"\D", "")) >= 6)
    )


def plmn_only(c: Column | str) -> Column:
    """A network code without a cell."""
    return F.regexp_replace(text(c), r"\D", "").rlike(r"^(404|405)\d{2,3}$")


def cell_key(c: Column | str) -> Column:
    """Upper case letters and digits of a cell id."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def cgi_key(c: Column | str) -> Column:
    """Master key of a cell: upper case, no spaces, runs of hyphens as one."""
    return F.regexp_replace(F.regexp_replace(F.upper(text(c)), r"\s+", ""), "-+", "-")


def cell_aliases(c: Column | str) -> Column:
    """Textual variants under which operators write one cell."""
    t = F.upper(text(c))
    parts = F.filter(F.split(t, r"\D+"), lambda x: x != "")
    joined = F.array_join(parts, "")
    plmn5 = F.length(F.try_element_at(parts, F.lit(1))) + F.length(F.try_element_at(parts, F.lit(2))) == 5
    padded = F.array_join(
        F.transform(parts, lambda x, i: F.when((i == 2) & (F.length(x) < 5), F.lpad(x, 5, "0")).otherwise(x)), ""
    )
    return F.array_distinct(
        F.filter(F.array(t, F.regexp_replace(t, "[^A-Z0-9]", ""), joined, F.when(plmn5, padded)), lambda x: x.isNotNull() & (x != ""))
    )


def cells_match(a: Column | str, b: Column | str) -> Column:
    return F.arrays_overlap(cell_aliases(a), cell_aliases(b))


def cgi_parts(c: Column | str) -> Column:
    """MCC, MNC, LAC and cell id of a CGI with separators; null where a part is missing or out of range."""
    p = F.filter(F.split(text(c), r"\D+"), lambda x: x != "")

    def part(i, lo, hi):
        v = F.try_element_at(p, F.lit(i))
        return F.when(v.try_cast("long").between(lo, hi), v)

    return F.struct(
        part(1, 1, 999).alias("mcc"),
        part(2, 0, 999).alias("mnc"),
        part(3, 0, 65535).alias("lac"),
        part(4, 0, 268435455).alias("cell_id"),
    )


def lat_lon(c: Column | str) -> Column:
    """Latitude and longitude from text; swapped where only that order is in range."""
    t = text(c)
    pair = r"(-?\d{1,3}(?:\.\d+)?)\s*[,/ ]\s*(-?\d{1,3}(?:\.\d+)?)"
    a = F.regexp_extract(t, pair, 1).try_cast("double")
    b = F.regexp_extract(t, pair, 2).try_cast("double")
    straight = a.between(-90, 90) & b.between(-180, 180)
    swapped = b.between(-90, 90) & a.between(-180, 180)
    return F.when(straight, F.struct(a.alias("lat"), b.alias("lon"))).when(swapped, F.struct(b.alias("lat"), a.alias("lon")))


def duration_seconds(c: Column | str) -> Column:
    """Seconds of a number, HH:MM:SS or MM:SS; what is neither counts zero."""
    t = text(c)
    p = F.split(t, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.coalesce(
        F.when(t.rlike(r"^\d+:\d{1,2}:\d{1,2}$"), n(1) * 3600 + n(2) * 60 + n(3))
        .when(t.rlike(r"^\d+:\d{1,2}$"), n(1) * 60 + n(2))
        .otherwise(t.try_cast("double")),
        F.lit(0.0),
    )


#: Accepted layouts of event times, in order; day first where it is ambiguous.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "dd-MM-yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "dd-MMM-yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm",
    "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
)


#: The same layouts with the month first in numeric dates.
MONTH_FIRST = tuple(f.replace("dd-MM-", "MM-dd-").replace("dd/MM/", "MM/dd/").replace("dd.MM.", "MM.dd.") for f in TIME_FORMATS)


def layout_shape(layout: str) -> str:
    """Regular expression that every text fits which the time layout can read: a text that cannot be read costs an exception,
    a hundred times as much as a text that is not tried."""
    return "^" + re.sub("yyyy|MMM|MM|dd|HH|mm|ss|'T'|[/.]", lambda m: {"yyyy": r"[-+]?\d{4,}", "MMM": r"\D+", "'T'": "T"}.get(m[0], r"\d\d" if m[0].isalpha() else "\\" + m[0]), layout) + "$"


def event_time(c: Column | str, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    """Naive timestamp from text by the first layout that fits, else null; a number from 20000 to 80000 is a day of a
    spreadsheet (counted from 1899-12-30)."""
    t = F.btrim(text(c), F.lit("'\""))
    n = F.when(t.rlike(r"^[2-8]\d{4}(\.\d+)?$"), t.try_cast("double"))
    day = F.when(n <= 80_000, F.floor(n).cast("int"))
    serial = F.lit("1899-12-30").cast("timestamp_ntz") + F.make_dt_interval(day, F.lit(0), F.lit(0), F.round((n - day) * 86_400).cast("decimal(18,6)"))
    time = F.coalesce(*[F.when(t.rlike(layout_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in formats], serial)
    return F.when(t != "", time).cast("timestamp_ntz")


def port_text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double").cast("long").cast("string"), F.lit(""))


def endpoint(ip: Column | str, port: Column | str) -> Column:
    """``ip:port``, with brackets around an IPv6 address; the address alone without a port."""
    i, p = text(ip), port_text(port)
    return F.when(i == "", "").when(p == "", i).when(i.contains(":"), F.concat(F.lit("["), i, F.lit("]:"), p)).otherwise(F.concat(i, F.lit(":"), p))


def stable_key(*cols: Column | str) -> Column:
    """24 hex digits of the SHA-256 over trimmed lower-case values joined by a bar; blanks hold their place."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(text(c)) for c in cols]), 256), 1, 24)


def cell_transition(first: Column | str, last: Column | str, searched: Column | str) -> Column:
    f, l, s = cell_key(first), cell_key(last), cell_key(searched)  # noqa: E741
    return (
        F.when((f == "") & (l == ""), "UNKNOWN")
        .when((f == "") | (l == ""), "PARTIAL")
        .when((f == l) & (f == s), "SAME_SEARCHED_CELL")
        .when(f == l, "SAME_OTHER_CELL")
        .otherwise("CHANGED_CELL")
    )


def formula_safe(c: Column | str) -> Column:
    """Text that a spreadsheet will not run: a quote before what would start a formula."""
    return F.when(col(c).rlike(r"^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def canonical_ip(c: Column | str, keep_invalid: bool = False) -> Column:
    """Compressed form of an IPv4 or IPv6 address (an interface keeps its prefix); invalid text is blank or kept.

    Spark has no function that compresses IPv6, so batches go to Python by Arrow.
    """
    def canonical(values):
        import ipaddress

        def one(v):
            t = (v or "").strip()
            try:
                return str(ipaddress.ip_interface(t) if "/" in t else ipaddress.ip_address(t)) if t else ""
            except ValueError:
                return t if keep_invalid else ""

        return values.map({v: one(v) for v in values.unique()})

    return F.pandas_udf(canonical, "string", F.PandasUDFType.SCALAR)(col(c).cast("string"))


def is_target(c: Column | str, target: Column | str) -> Column:
    """Whether a number is the target's, by party key."""
    t = party_key(F.lit(target) if isinstance(target, str) else target)
    return (party_key(c) == t) & (t != "")


def address_lat_lon(c: Column | str) -> Column:
    """Coordinates named in an address text (``lat …``, ``long …``), where both are in range."""
    t = text(c)
    number = r"\s*[-:=]?\s*(-?\d+(?:\.\d+)?)"
    lat = F.regexp_extract(t, "(?i)lat(?:itude)?" + number, 1).try_cast("double")
    lon = F.regexp_extract(t, "(?i)lon(?:g|gitude)?" + number, 1).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def local_time(c: Column | str, zone: str = "Asia/Kolkata") -> Column:
    """Text of a UTC time in a zone."""
    return F.date_format(F.from_utc_timestamp(col(c).cast("timestamp"), zone), "dd-MM-yyyy HH:mm:ss")


def filled_from(c: Column | str, other: Column | str) -> Column:
    """The value, or where it is blank the other one."""
    return F.coalesce(blank_to_null(c), col(other))
