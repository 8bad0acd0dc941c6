"""Fixed values of the engine: catalogue of sources, sections, rules and limits. All are published constants, kept as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sources, as id | name | tier | type | family | url.
_SOURCES = """
krebs | Krebs on Security | Security Research | news | krebs | https://krebsonsecurity.com/feed/
cisa | CISA Alerts | Government | cert | cisa | https://www.cisa.gov/cybersecurity-advisories/all.xml
recorded-future | Recorded Future | Security Research | vendor | recorded-future | https://www.recordedfuture.com/feed
microsoft-security | Microsoft Security Blog | Security Research | vendor | microsoft | https://www.microsoft.com/en-us/security/blog/feed/
sans-isc | SANS ISC | Enterprise Security | research | sans | https://isc.sans.edu/rssfeed_full.xml
dark-reading | Dark Reading | Enterprise Security | news | dark-reading | https://www.darkreading.com/rss.xml
crowdstrike | CrowdStrike Blog | Enterprise Security | vendor | crowdstrike | https://www.crowdstrike.com/en-us/blog/feed
bleeping-computer | Bleeping Computer | Threat Intelligence | news | bleeping-computer | https://www.bleepingcomputer.com/feed/
hacker-news | The Hacker News | Threat Intelligence | news | hacker-news | https://feeds.feedburner.com/TheHackersNews
help-net-security | Help Net Security | Threat Intelligence | news | help-net-security | https://www.helpnetsecurity.com/feed/
techcrunch-security | TechCrunch Security | Tech & General | news | techcrunch | https://techcrunch.com/category/security/feed/
cso-online | CSO Online | Executive News | news | cso-online | https://www.csoonline.com/feed/
hackread | Hackread | Threat Intelligence | news | hackread | https://hackread.com/feed/
databreaches | DataBreaches.net | Threat Intelligence | news | databreaches | https://databreaches.net/feed/
cis-advisories | CIS Advisories | Government | cert | cis | https://www.cisecurity.org/feed/advisories
cert-cc | CERT/CC Vulnerability Notes | Government | cert | cert-cc | https://www.kb.cert.org/vulfeed/
graham-cluley | Graham Cluley | Security Research | research | graham-cluley | https://grahamcluley.com/feed/
schneier | Schneier on Security | Security Research | research | schneier | https://www.schneier.com/feed/atom/
reversinglabs | ReversingLabs | Security Research | vendor | reversinglabs | https://www.reversinglabs.com/blog/rss.xml
computer-weekly | Computer Weekly Security | Executive News | news | computer-weekly | https://www.computerweekly.com/rss/IT-security.xml
cert-eu | CERT-EU Security Advisories | Government | cert | cert-eu | https://www.cert.europa.eu/publications/security-advisories-rss
ncsc-uk | NCSC-UK | Government | cert | ncsc-uk | https://www.ncsc.gov.uk/api/1/services/v1/all-rss-feed.xml
paloalto-psirt | Palo Alto Security Advisories | Enterprise Security | advisory | palo-alto | https://security.paloaltonetworks.com/rss.xml
cisco-psirt | Cisco Security Advisories | Enterprise Security | advisory | cisco | https://sec.cloudapps.cisco.com/security/center/psirtrss20/CiscoSecurityAdvisory.xml
fortinet-psirt | Fortinet Security Advisories | Enterprise Security | advisory | fortinet | https://filestore.fortinet.com/fortiguard/rss/ir.xml
ivanti-security | Ivanti Security Advisories | Enterprise Security | advisory | ivanti | https://www.ivanti.com/blog/topics/security-advisory/rss
chrome-releases | Chrome Releases | Enterprise Security | advisory | google | https://chromereleases.googleblog.com/feeds/posts/default/-/Stable%20updates/Desktop%20Update?max-results=5
cccs | CCCS Alerts and Advisories | Government | cert | cccs | https://www.cyber.gc.ca/api/cccs/atom/v1/get?feed=alerts_advisories&lang=en
jpcert-en | JPCERT/CC | Government | cert | jpcert | https://www.jpcert.or.jp/english/rss/jpcert-en.rdf
unit42 | Unit 42 | Threat Intelligence | vendor | palo-alto | https://unit42.paloaltonetworks.com/feed/
talos | Cisco Talos | Threat Intelligence | vendor | cisco | https://blog.talosintelligence.com/rss/
google-threat-intel | Google Threat Intelligence | Threat Intelligence | vendor | google | https://cloudblog.withgoogle.com/topics/threat-intelligence/rss/
eset-research | ESET WeLiveSecurity | Threat Intelligence | vendor | eset | https://www.welivesecurity.com/en/rss/feed/
securelist | Securelist | Threat Intelligence | vendor | kaspersky | https://securelist.com/feed/
sentinellabs | SentinelLabs | Threat Intelligence | vendor | sentinelone | https://www.sentinelone.com/labs/feed/
check-point-research | Check Point Research | Threat Intelligence | vendor | check-point | https://research.checkpoint.com/feed/
proofpoint-threat-insight | Proofpoint Threat Insight | Threat Intelligence | vendor | proofpoint | https://www.proofpoint.com/us/threat-insight-blog.xml
dfir-report | The DFIR Report | Security Research | research | dfir-report | https://thedfirreport.com/feed/
citizen-lab | Citizen Lab | Security Research | research | citizen-lab | https://citizenlab.ca/feed/
huntress | Huntress Blog | Threat Intelligence | vendor | huntress | https://www.huntress.com/blog/rss.xml
sekoia | Sekoia Blog | Threat Intelligence | vendor | sekoia | https://www.sekoia.com/blog/rss.xml
nviso-labs | NVISO Labs | Threat Intelligence | vendor | nviso | https://blog.nviso.eu/category/incident-response/feed/
the-record | The Record | Threat Intelligence | news | recorded-future | https://therecord.media/feed
securityweek | SecurityWeek | Enterprise Security | news | securityweek | https://www.securityweek.com/feed/
the-register-security | The Register Security | Tech & General | news | the-register | https://api.theregister.com/api/v1/article?orderBy=published&site_id=2&remapper=rss&query=tag:security
project-zero | Google Project Zero | Security Research | research | google | https://projectzero.google/feed.xml
sophos-xops | Sophos X-Ops | Threat Intelligence | vendor | sophos | https://www.sophos.com/en-us/category/threat-research/feed
zscaler-threatlabz | Zscaler ThreatLabz | Threat Intelligence | vendor | zscaler | https://www.zscaler.com/blogs/feeds/security-research
volexity | Volexity | Threat Intelligence | vendor | volexity | https://www.volexity.com/feed/
watchtowr-labs | watchTowr Labs | Threat Intelligence | vendor | watchtowr | https://labs.watchtowr.com/rss/
portswigger-research | PortSwigger Research | Threat Intelligence | vendor | portswigger | https://portswigger.net/research/rss
"""
# Words of which a title must have one, where a source asks for it, and more words for two of the sources.
_TITLE_WORDS = r"attack(?:s|er|ers)?|campaigns?|malware|exploit(?:s|ed|ing)?|compromis(?:e|es|ed)|phishing|ransomware|webshells?|backdoors?|botnets?|threat actors?|vulnerabilit(?:y|ies)|zero-days?|breach(?:es)?|CVE-\d{4}-\d+"
_MORE_WORDS = r"infostealers?|trojan(?:s|ised|ized)?|intrusions?|APT\d*"
TITLE_INCLUDE = {
    "eset-research": rf"(?i)^.*?\b(?:{_TITLE_WORDS}|{_MORE_WORDS}|flaws?|hack(?:s|ed)?)\b",
    "huntress": rf"(?i)^.*?\b(?:{_TITLE_WORDS})\b",
    "sekoia": rf"(?i)^.*?\b(?:{_TITLE_WORDS}|{_MORE_WORDS})\b",
}
# Newest items taken of a source; body bytes where not the default; sources whose HTML content type is accepted.
MAX_ITEMS = {s: 5 for s in ("paloalto-psirt", "cisco-psirt", "fortinet-psirt", "cccs", "sekoia", "the-register-security")}
MAX_BODY = {"cisa": 10 * 1024 * 1024}
HTML_OK = {"krebs"}
BODY_BYTES = 2 * 1024 * 1024

# Hours back by source type; weight by tier; half-life of the score in hours.
LOOKBACK = {"news": 24, "research": 24, "vendor": 72, "cert": 72, "government": 72, "advisory": 72}
WEIGHTS = {"Government": 1.5, "Security Research": 1.3, "Threat Intelligence": 1.3, "Enterprise Security": 1.15, "Executive News": 1.15, "Tech & General": 1.0}
HALF_LIFE = 6

# Sections as shown; keywords of sections in the order in which they are tried; the section of the rest.
SECTIONS = ["Vulnerabilities", "Advisories", "Ransomware", "Breaches", "Threat Intelligence", "Tools/Techniques", "Industry/Policy"]
KEYWORDS = {
    "Vulnerabilities": ["CVE-", "vulnerability", "vulnerabilities", "zero-day", "0-day", "exploit", "exploited", "exploitation", "flaw", "patch", "patched"],
    "Ransomware": ["ransomware", "malware", "trojan", "computer worm", "ransom"],
    "Breaches": ["breach", "breached", "data leak", "leaked", "leak", "compromise", "compromised", "unauthorized access"],
    "Advisories": ["advisory", "advisories", "security bulletin", "warns", "warning"],
    "Threat Intelligence": ["APT", "threat actor", "threat group", r"re:TA\d{1,5}", "state-sponsored", "nation-state", "campaign", "malicious actor"],
    "Tools/Techniques": ["tool", "technique", "framework", "methodology", "defense", "detection"],
}
REST = "Industry/Policy"

# Patterns of importance, tried in this order; \b is a boundary of ASCII words.
CRITICAL = [
    (r"(?i)\b(?:actively|being|widely) exploited\b|\bexploited in the wild\b|\bin-the-wild exploit", "Actively exploited"),
    (r"(?i)\bunder (?:active )?attack\b|\bmass[- ]exploitation\b|\bexploit(?:ation)? attempts?\b", "Actively exploited"),
    (r"(?i)\bzero[- ]days?\b|\b0[- ]?days?\b", "Zero-day"),
    (r"\bknown exploited vulnerabilit(?:y|ies)\b|\bKEV\b", "CISA KEV"),
    (r"(?i)\bemergency (?:directive|patch|update|fix)(?:e?s)?\b|\bpatch (?:now|immediately)\b", "Emergency patch"),
]
HIGH = [
    (r"(?i)\bcritical (?:flaw|bug|vulnerabilit(?:y|ies)|severity|security update|update)s?\b|\bCVSS(?: score)?(?: of)? (?:9|10)(?:\.\d)?\b", "Critical severity"),
    (r"(?i)\bremote code execution\b|\bRCE\b|\bauthentication bypass\b|\bauth bypass\b", "Remote compromise"),
    (r"(?i)\bproof[- ]of[- ]concept\b|\bPoC (?:exploit|released|published)\b|\bexploit (?:code|released|published)\b", "Public exploit"),
    (r"(?i)\bsupply[- ]chain (?:attack|compromise)s?\b", "Supply-chain attack"),
    (r"(?i)\bransomware\b", "Ransomware"),
]

# Query fields that only track (besides utm_...); zones of feed dates; named entities.
TRACKING = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "yclid", "spm", "ref", "ref_src", "_hsenc", "_hsmi", "mkt_tok"]
ZONES = {"CET": "+0100", "CEST": "+0200", "EET": "+0200", "EEST": "+0300", "BST": "+0100", "WET": "+0000", "WEST": "+0100", "MSK": "+0300"}
US_ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "trade": "™", "mdash": "—", "ndash": "–", "hellip": "…",
    "copy": "©", "reg": "®", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’",
}

# The shape of a CVE id.
CVE_ID = r"^CVE-\d{4}-\d{4,7}$"
# Seconds after which a result is renewed.
REFRESH_SECONDS = {"edition": 900, "kev": 21_600, "epss": 3_600, "ssvc": 21_600}
# Pages of one poll of the logs at most.
POLL_PAGES = 20

# Limits.
SUMMARY_CHARS, CHIPS, SECTION_CAP, MIN_HIDDEN = 400, 3, 6, 3
KEV_MIN, KEV_SKIPPED, KEV_SLIM_BYTES, KEV_FIRST, KEV_HOURS = 1500, 0.01, 256 * 1024, "2021-11-03", 72
EPSS_BATCH, EPSS_IDS, EPSS_STRONG, SSVC_LOOKUPS = 50, 500, 0.1, 100
ADP_ORG = "134c704f-9b21-4f2e-91b3-4a467353bcc0"
MARK_MS = 7 * 24 * 60 * 60 * 1000
UNIT_BYTES, DAY_MIN = 8192, 1440
PRODUCERS = ["edition", "kev", "ssvc", "epss", "render"]
BUDGET_KEYS = ["p", "ok", "ms", "cpuMs", "n", "bytes", "rcW", "rcR", "kvCmd"]
SSVC_STATES = ["assessed", "not-assessed", "failed"]
GAP_REASONS = ["cli-exit", "timeout", "excluded", "truncated", "missed-poll"]
#: Whitespace as feeds' tools see it, as a character class body.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters as text.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def site_url(env: dict[str, str], production: bool = False) -> str:
    """The public origin without a slash at its end: SITE_URL, else the local one, which is an error in production."""
    given = env.get("SITE_URL", "").strip().rstrip("/")
    if not given and production:
        raise ValueError("SITE_URL must be set in production")
    return given or "http://localhost:4000"


def sources() -> list[dict]:
    """The catalogue of sources, in order."""
    out = []
    for line in _SOURCES.strip().splitlines():
        i, name, tier, kind, family, url = (x.strip() for x in line.split(" | "))
        out.append({"source_id": i, "name": name, "tier": tier, "source_type": kind, "lang": "en", "family": family, "url": url, "allow_html": i in HTML_OK, "max_items": MAX_ITEMS.get(i), "max_body_bytes": MAX_BODY.get(i), "title_include": TITLE_INCLUDE.get(i)})
    return out


def sources_df(spark: SparkSession) -> DataFrame:
    kind = "source_pos int, source_id string, name string, tier string, source_type string, lang string, family string, url string, allow_html boolean, max_items int, max_body_bytes long, title_include string"
    return spark.createDataFrame([(k, *s.values()) for k, s in enumerate(sources())], kind)
