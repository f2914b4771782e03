"""Scalar functions as Column expressions: scores, strings, addresses, dates. NULL stands for "unmeasured" throughout."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scores


def saturating(value: Column, scale: float) -> Column:
    """1 - exp(-max(value, 0) / scale)."""
    return 1 - F.exp(-F.greatest(value.cast("double"), F.lit(0.0)) / scale)


def rarity(hosts: Column) -> Column:
    """1 / sqrt(max(hosts, 1))."""
    return 1 / F.sqrt(F.greatest(hosts.cast("double"), F.lit(1.0)))


def ramp(x: Column, low: float, high: float) -> Column:
    """Linear from 0 at ``low`` to 1 at ``high``, clipped; NULL stays NULL."""
    raised = (x - low) / (high - low)
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), raised)))


def soft_or(a: Column, b: Column) -> Column:
    return 1 - (1 - a) * (1 - b)


def geometric_mean(parts: Sequence[tuple[Column, float]], floor: float = 0.01) -> Column:
    """Weighted geometric mean over the measured parts, each at least ``floor``; weights of NULL parts drop out."""
    total = weight = None
    for part, w in parts:
        known = part.isNotNull()
        log = F.when(known, w * F.ln(F.greatest(part.cast("double"), F.lit(floor)))).otherwise(0.0)
        own = F.when(known, F.lit(w)).otherwise(0.0)
        total, weight = (log, own) if total is None else (total + log, weight + own)
    return F.when(weight > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(total / weight))))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` that are computed once a row.

    As plain columns Spark would write each one's formula out wherever a later column or filter names it; one made of four such
    parts, and filtered, then evaluates every part some ten times.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def robust_deviation(value: Column, median: Column, mad: Column, samples: Column) -> Column:
    """(value - median) / (1.4826 MAD); NULL under 3 samples or without spread."""
    return F.when((samples >= 3) & (mad > 0), (value - median) / (1.4826 * mad))


def dispersion(median: Column, mad: Column) -> Column:
    """MAD over the absolute median; 1 where there is no median or it is about 0."""
    return F.when(median.isNull() | (F.abs(median) < 1e-9), F.lit(1.0)).otherwise(mad / F.abs(median))


def surprisal(p: Column, cap_bits: float = 6.0) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1.0), -F.log2(p) / cap_bits))


def half_life(base: Column, age_days: Column, days: float = 180.0) -> Column:
    return base * F.pow(F.lit(0.5), age_days / days)


def corroboration(behaviours: Column, step: float = 0.5, most: float = 2.5) -> Column:
    return F.least(1 + step * F.greatest(behaviours - 1, F.lit(0)), F.lit(most))


# ---------------------------------------------------------------- names

#: Two-label public suffixes under which the registered name has three labels.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "co.za", "co.jp", "ne.jp", "or.jp",
    "com.br", "com.cn", "com.mx", "com.tr", "co.in",
)


def labels(name: Column) -> Column:
    """Lower-case labels of a name, empty ones dropped."""
    return F.filter(F.split(F.lower(F.trim(name)), r"\."), lambda x: x != "")


def registered_domain(name: Column) -> Column:
    """The last two labels, or three under a two-label suffix; a single label is itself."""
    parts = labels(name)
    two = F.array_join(F.slice(parts, -2, 2), ".")
    return F.when(F.size(parts) <= 2, F.array_join(parts, ".")).when(two.isin(*TWO_LABEL_SUFFIXES), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(two)


def subdomain_of(name: Column, zone: Column) -> Column:
    """What stands before the zone, without dots."""
    clean = F.array_join(labels(name), ".")
    return F.replace(F.when(F.endswith(clean, zone), F.left(clean, F.length(clean) - F.length(zone))).otherwise(clean), F.lit("."), F.lit(""))


def first_label(name: Column) -> Column:
    return F.try_element_at(F.split(name, r"\."), F.lit(1))


def after_first_label(name: Column) -> Column:
    """The name without its first label; NULL without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"^[^.]*\.", ""))


def longest_consonant_run(label: Column) -> Column:
    """Letters other than aeiou in a row; anything else breaks the run."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.lower(label), F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), F.length)), F.lit(0))


def digit_ratio(label: Column) -> Column:
    return F.when(F.length(label) > 0, F.length(F.regexp_replace(label, "[^0-9]", "")) / F.length(label)).otherwise(0.0)


def byte_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the UTF-8 bytes; 0 for empty text."""
    digits = F.hex(F.encode(text, "UTF-8"))
    each = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    n = F.size(each)
    shares = F.transform(F.array_distinct(each), lambda b: F.size(F.filter(each, lambda x: x == b)) / n)
    return F.when(n > 0, -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def image_name(path: Column) -> Column:
    """Lower-case file name after the last separator of either kind; NULL when empty."""
    return F.nullif(F.regexp_extract(F.lower(F.replace(path, F.lit("/"), F.lit("\\"))), r"([^\\]*)$", 1), F.lit(""))


#: Folders that any user can write to, and the system's own.
WRITABLE_FOLDERS = ("\\users\\", "\\appdata\\", "\\programdata\\", "\\temp\\", "\\tmp\\", "\\$recycle.bin\\", "\\public\\", "\\perflogs\\", "\\downloads\\")
SYSTEM_FOLDERS = ("\\windows\\system32\\", "\\windows\\syswow64\\")


def path_anomaly(path: Column) -> Column:
    """Prior of an image's folder: writable 1.0, system .15, below windows .30, elsewhere .55, unknown NULL."""
    low = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))

    def within(folders: Iterable[str]) -> Column:
        found = F.lit(False)
        for f in folders:
            found = found | F.contains(low, F.lit(f))
        return found

    return F.when(path.isNull() | (path == ""), F.lit(None).cast("double")).when(within(WRITABLE_FOLDERS), 1.0).when(within(SYSTEM_FOLDERS), 0.15).when(F.contains(low, F.lit("\\windows\\")), 0.30).otherwise(0.55)


# ---------------------------------------------------------------- alerts

SEVERITY_SCORES = {1: 1.0, 2: 0.6, 3: 0.3}
OTHER_SEVERITY = 0.4
SEVERITY_RANKS = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
#: Fragments of alert categories and their weights, in the order in which they are tried.
CATEGORY_WEIGHTS = (
    ("not suspicious", 0.10), ("not-suspicious", 0.10), ("unknown traffic", 0.25),
    ("network trojan", 1.00), ("trojan-activity", 1.00), ("command and control", 1.00), ("malware", 1.00), ("crypto", 0.85),
    ("shellcode", 0.95), ("executable code was detected", 0.95), ("exploit", 0.95),
    ("administrator privilege gain", 0.90), ("attempted-admin", 0.90), ("successful-admin", 0.95),
    ("user privilege gain", 0.80), ("attempted-user", 0.80),
    ("web application attack", 0.85), ("web-application-attack", 0.85), ("sql injection", 0.85),
    ("credential", 0.90), ("sensitive data", 0.75),
    ("denial of service", 0.60), ("attempted-dos", 0.60), ("potentially bad traffic", 0.55), ("bad-unknown", 0.55), ("suspicious", 0.55),
    ("network scan", 0.50), ("network-scan", 0.50), ("scan", 0.50),
    ("privacy violation", 0.35), ("policy", 0.30), ("misc attack", 0.50), ("misc activity", 0.25), ("misc-activity", 0.25), ("protocol", 0.25),
)
OTHER_CATEGORY = 0.40


def severity_score(severity: Column) -> Column:
    out = F.when(severity == 1, SEVERITY_SCORES[1])
    for k in (2, 3):
        out = out.when(severity == k, SEVERITY_SCORES[k])
    return out.otherwise(OTHER_SEVERITY)


def category_weight(category: Column) -> Column:
    """The first fragment that the category holds decides."""
    low, out = F.lower(category), F.when(category.isNull() | (category == ""), OTHER_CATEGORY)
    for fragment, weight in CATEGORY_WEIGHTS:
        out = out.when(F.contains(low, F.lit(fragment)), weight)
    return out.otherwise(OTHER_CATEGORY)


def severity_rank(severity: Column) -> Column:
    return mapped(severity, SEVERITY_RANKS)


def mapped(key: Column, values: Mapping) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


# ---------------------------------------------------------------- addresses and indicators

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
DOMAIN = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
IPV6_SHAPE = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*(%.*)?$"


def is_ipv4(text: Column) -> Column:
    return text.rlike(IPV4)


def ipv4_number(text: Column) -> Column:
    """The address as a whole number; NULL if it isn't one."""
    part = F.split(text, r"\.")
    good = F.forall(part, lambda x: F.coalesce(x.try_cast("int").between(0, 255) & (x.try_cast("int").cast("string") == x), F.lit(False)))
    number = F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n * 256 + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when((F.size(part) == 4) & good, number)


def ipv4_network(number: Column, prefix: Column | int) -> Column:
    """The first address of the network that has ``prefix`` leading bits."""
    size = F.pow(F.lit(2.0), 32 - (F.lit(prefix) if isinstance(prefix, int) else prefix)).cast("long")
    return number - F.pmod(number, size)


def indicator_kind(value: Column) -> Column:
    """url, file_hash, cidr, ip or domain, from least to most ambiguous; NULL for anything else."""
    text = F.trim(value)
    host, _, tail = F.split_part(text, F.lit("/"), F.lit(1)), None, F.split_part(text, F.lit("/"), F.lit(2))
    slash = F.contains(text, F.lit("/"))
    bits = tail.try_cast("int")
    network = (is_ipv4(host) & bits.between(0, 32)) | (host.rlike(IPV6_SHAPE) & bits.between(0, 128))
    return (
        F.when(text == "", None)
        .when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), "url")
        .when(F.length(text).isin(32, 40, 64, 128) & text.rlike("^[0-9A-Fa-f]+$"), "file_hash")
        .when(slash & network, "cidr")
        .when(slash, F.when(F.contains(host, F.lit(".")), "url"))
        .when(is_ipv4(text) | text.rlike(IPV6_SHAPE), "ip")
        .when(F.rtrim(text, F.lit(".")).rlike(DOMAIN), "domain")
    )


def normal_indicator(value: Column, kind: Column) -> Column:
    """One spelling for each indicator."""

    def spelt(s: Column) -> Column:
        text, own = s["text"], s["kind"]
        host, bits = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
        four = _named(ipv4_network(ipv4_number(host), bits.try_cast("int")), lambda n: F.concat(dotted(n), F.lit("/"), bits))
        words = lambda key: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.substr(key, k * 4 + 1, F.lit(4))), ":")
        six = _named(network_key(F.array_join(ipv6_groups(host), ""), bits.try_cast("int")), lambda key: F.concat(canonical_ipv6(words(key)), F.lit("/"), bits))
        network = F.coalesce(F.when(F.contains(host, F.lit(":")), six).otherwise(four), text)
        return F.when(own == "domain", F.lower(F.rtrim(text, F.lit(".")))).when(own == "file_hash", F.lower(text)).when(own == "cidr", network).when(own == "ip", canonical_ipv6(text)).otherwise(text)

    return _named(F.struct(F.trim(value).alias("text"), kind.alias("kind")), spelt)


def dotted(number: Column) -> Column:
    """The IPv4 address of a whole number; NULL of NULL."""
    return F.when(number.isNotNull(), F.array_join(F.transform(F.array(*[F.lit(1 << k) for k in (24, 16, 8, 0)]), lambda shift: F.pmod(F.floor(number / shift), F.lit(256)).cast("string")), "."))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an IPv6 address, as four hexadecimal digits each; NULL if it isn't one. A zone is left out."""
    none = F.array().cast("array<string>")

    def spelt_out(low: Column) -> Column:
        tail = F.regexp_extract(low, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        both = _named(ipv4_number(tail), lambda n: F.concat(F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(F.pmod(n, F.lit(65536))))))
        return F.when(tail == "", low).otherwise(F.concat(F.left(low, F.length(low) - F.length(tail)), both))

    def filled(halves: Column) -> Column:
        left, right = (F.when(F.coalesce(F.get(halves, F.lit(k)), F.lit("")) == "", none).otherwise(F.split(F.get(halves, F.lit(k)), ":")) for k in (0, 1))
        gap = 8 - F.size(left) - F.size(right)
        return F.when((F.size(halves) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap.cast("int")), right)).when((F.size(halves) == 1) & (gap == 0), left)

    def checked(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(groups, lambda g: F.lpad(g, 4, "0")))

    low = F.when(text.rlike(IPV6_SHAPE), F.lower(F.split_part(F.trim(text), F.lit("%"), F.lit(1))))
    return _named(_named(_named(low, spelt_out), lambda plain: F.split(plain, "::")), lambda halves: _named(filled(halves), checked))


def canonical_ipv6(text: Column) -> Column:
    """The short spelling of an IPv6 address (lower case, the longest run of zeros left out); anything else unchanged."""

    def shortened(spelt: Column) -> Column:
        short = spelt
        for k in range(2, 9):  # the longest run is asked for last, so it decides
            run = rf"^(|.*?:)0(?::0){{{k - 1}}}(|:.*)$"
            short = F.when(spelt.rlike(run), F.concat(F.regexp_replace(F.regexp_extract(spelt, run, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(spelt, run, 2), "^:", ""))).otherwise(short)
        return short

    spelt = F.array_join(F.transform(ipv6_groups(text), lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    zone = F.regexp_extract(F.trim(text), "(%.*)$", 1)
    return F.when(F.contains(text, F.lit(":")), F.coalesce(F.concat(_named(spelt, shortened), zone), text)).otherwise(text)


def address_key(text: Column) -> Column:
    """An address as hexadecimal digits, 8 of IPv4 and 32 of IPv6; NULL if it isn't one."""
    return _named(text, lambda t: F.when(F.contains(t, F.lit(":")), F.array_join(ipv6_groups(t), "")).otherwise(F.lower(F.lpad(F.hex(ipv4_number(t)), 8, "0"))))


def network_key(key: Column, prefix: Column) -> Column:
    """The key of the first address of the network that has ``prefix`` leading bits."""

    def cut(k: Column, bits: Column) -> Column:
        whole, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
        digit = F.conv(F.substr(k, whole + 1, F.lit(1)), 16, 10).cast("int")
        size = F.element_at(F.array(*[F.lit(16 >> n) for n in range(4)]), (rest + 1).cast("int"))
        last = F.when(rest == 0, "").otherwise(F.lower(F.conv((digit - F.pmod(digit, size)).cast("string"), 10, 16)))
        return F.when(bits <= F.length(k) * 4, F.rpad(F.concat(F.left(k, whole), last), F.length(k), F.lit("0")))

    return _named(F.struct(key.alias("key"), prefix.alias("bits")), lambda s: cut(s["key"], s["bits"]))


def network_last(base: Column, prefix: Column) -> Column:
    """The key of the last address of the network with ``prefix`` leading bits whose first address has the key ``base``."""

    def fill(k: Column, bits: Column) -> Column:
        whole, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4)).cast("int")
        digit = F.conv(F.substr(k, whole + 1, F.lit(1)), 16, 10).cast("int")
        size = F.element_at(F.array(*[F.lit(16 >> n) for n in range(4)]), rest + 1)
        last = F.when(rest == 0, "").otherwise(F.lower(F.conv((digit + size - 1).cast("string"), 10, 16)))
        return F.rpad(F.concat(F.left(k, whole), last), F.length(k), F.lit("f"))

    return _named(F.struct(base.alias("key"), prefix.alias("bits")), lambda s: fill(s["key"], s["bits"]))


# ---------------------------------------------------------------- dates and ids


def parse_date(text: Column) -> Column:
    """Dates in the forms that feeds use; NULL where none fits."""
    clean = F.trim(F.regexp_replace(F.trim(text), "[Zz]+$", ""))
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in forms]).cast("date")  # read and cut in one time zone


def confidence(text: Column) -> Column:
    """``0.85`` or ``85%`` as a share; NULL outside 0..1."""
    clean = F.trim(text)
    value = F.rtrim(clean, F.lit("%")).try_cast("double") / F.when(F.endswith(clean, F.lit("%")), 100.0).otherwise(1.0)
    return F.when(value.between(0, 1), value)


def epoch(timestamp: Column) -> Column:
    """Seconds since 1970 of a timestamp's own clock reading."""
    return F.datediff(F.to_date(timestamp), F.lit("1970-01-01").cast("date")) * 86400.0 + F.hour(timestamp) * 3600 + F.minute(timestamp) * 60 + F.date_part(F.lit("SECOND"), timestamp).cast("double")


def utc_date(seconds: Column) -> Column:
    """The UTC day of seconds since 1970, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def entity_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(F.trim(value)))


def content_id(prefix: str, *parts: Column) -> Column:
    """A short id of the parts' content: equal content, equal id."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])), 256), F.lit(16)))


def printable(text: Column, most: int = 512) -> Column:
    return F.left(F.regexp_replace(text, r"\p{C}", ""), F.lit(most))
