"""Label normalisation and attack families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attack names by family (fixed values).
FAMILIES = {
    "Normal": ["normal"],
    "Attack (Unspecified)": ["attack"],
    "DoS": ["back", "land", "neptune", "pod", "smurf", "teardrop", "apache2", "udpstorm", "processtable", "mailbomb", "worm"],
    "Probe": ["ipsweep", "nmap", "portsweep", "satan", "mscan", "saint"],
    "R2L": ["ftp_write", "guess_passwd", "imap", "multihop", "phf", "spy", "warezclient", "warezmaster", "sendmail", "named", "snmpgetattack", "snmpguess", "xlock", "xsnoop", "httptunnel"],
    "U2R": ["buffer_overflow", "loadmodule", "perl", "rootkit", "ps", "sqlattack", "xterm"],
}
#: Families and the substrings of a label that stand for them; the first family that fits decides (fixed values).
PATTERNS = [
    ("DoS/DDoS", ["ddos", "dos hulk", "dos goldeneye", "dos slowloris", "dos slowhttptest"]),
    ("Brute Force", ["ftp-patator", "ssh-patator", "brute force"]),
    ("Web Attack", ["web attack", "sql injection", "xss"]),
    ("PortScan", ["portscan"]),
    ("Bot", ["bot"]),
    ("Infiltration", ["infiltration", "infilteration"]),
    ("Heartbleed", ["heartbleed"]),
]


def normalize_simple(label: str | Column) -> Column:
    """Trimmed, lower case, without dots at the end."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\.+$", "")


def normalize_spaced(label: str | Column) -> Column:
    """Replacement characters become hyphens and white space single blanks; case stays."""
    return F.trim(F.regexp_replace(F.translate(label, "�\u0096", "--"), r"\s+", " "))


def binary_label(label: str | Column, benign: str) -> Column:
    return F.when(normalize_simple(label) == benign, 0).otherwise(1)


def family_by_pattern(label: str | Column, benign: str = "benign") -> Column:
    text = F.lower(normalize_spaced(label))
    out = F.when(text == normalize_spaced(F.lit(benign.lower())), "Normal")
    for family, parts in PATTERNS:
        fits = F.lit(False)
        for p in parts:
            fits = fits | text.contains(p)
        out = out.when(fits, family)
    return out.otherwise("Unknown")
