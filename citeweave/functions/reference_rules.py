"""The word lists and patterns by which reference lists are read. Results depend on each of them and on their order."""

import re

# Words after a line-break hyphen that keep it.
COMPOUND_SUFFIXES = frozenset((
    "centered based driven aware oriented specific related dependent independent like free friendly rich poor scale level order class type style wise fold "
    "shot step time world source domain task modal intensive efficient agnostic invariant sensitive grained agent site"
).split())
KEPT_PHRASES = [(r"\bstate-\s+of-the-art\b", "state-of-the-art"), (r"\bagent-\s+generated\b", "agent-generated"), (r"\bai-\s+generated\b", "ai-generated")]

# Where a reference section begins and ends.
SECTION_HEADERS = [r"\n\s*References\s*\n", r"\n\s*Bibliography\s*\n", r"\n\s*Works Cited\s*\n"]
SECTION_ENDS = [
    re.compile(r"\n\s*(?:Appendix|Acknowledge?ments?|Supplementary|Ethics\s+Statement|Ethical\s+Considerations|Broader\s+Impact|Paper\s+Checklist|Checklist|Contents)\b", re.I),
    re.compile(r"(?:\.\s*){5,}"),
    re.compile(r"\n\s*[A-Z]\s+[A-Z][a-zA-Z-]+(?:\s+[a-zA-Z-]+)*\s*\n"),
]
LAST_SHARE = 0.7

# Lines that page headers leave in a reference section.
HEADER_VENUE = re.compile(r"^[A-Z][A-Z\s&]+\s*['\u2019]\d{2},\s+[A-Z][a-z]+\s+\d{1,2}[\u2013\-]+\d{1,2},\s+\d{4},\s+[A-Z][A-Za-z\s,]+$")
HEADER_AUTHORS = re.compile(r"^[A-Z]\.?[A-Z]?\s+[A-Z][a-z]+(?:,\s+[A-Z]\.?\s*[A-Z]?\.?\s*[A-Z][a-z]+)*(?:,?\s+and\s+[A-Z]\.?\s*[A-Z]?\.?\s*[A-Z][a-z]+)?$")
HEADER_CAPITALS = re.compile(r"^[A-Z][A-Z\s\-]+$")
PAGE_NUMBER = re.compile(r"^\d{1,4}$")

# What ends a reference list inside its section, after its first 500 characters.
_TOPICS = r"(?:Additional|Detailed|Extended|Supplemental|Proof|Experimental|Implementation|Benchmark|Dataset|Ablation|Hyperparameter)"
LIST_ENDS = [re.compile(p) for p in (
    r"\n\s*(?:APPENDIX|Appendix)\s*[A-Z]?\s*[\n:.]",
    r"\n\s*(?:SUPPLEMENTARY|Supplementary)\s+(?:MATERIAL|Material|INFORMATION|Information)",
    rf"\n\s*[A-Z]\s*\n\s*{_TOPICS}",
    rf"\n\s*[A-Z]\s*[\.:]?\s+{_TOPICS}\s+",
    r"\n\s*\(\d{1,3}\)\s*\n[^\n]*=",
)]

# How references begin, by style.
BRACKETED = re.compile(r"(?:^|\n)\s*\[(\d+)\]\s*")
ALPHABETIC = re.compile(r"\n\s*\[([A-Za-z+]+\d{2,4}[a-z]?)\]\s*")
NUMBERED = re.compile(r"(?:^|\n)\s*(\d+)\.\s+")
_BREAK = r"([a-z0-9)]|[A-Z]{2})\.\n(?:\d{1,4}\n)?\s*(?!In\s)"
SURNAME_FIRST = re.compile(_BREAK + r"([A-Z][a-zA-Z\u00C0-\u024F]+(?:[ -][A-Za-z\u00C0-\u024F]+)?,\s+[A-Z]\.)")
ORGANIZATION = re.compile(_BREAK + r"([A-Z][a-zA-Z\u00C0-\u024F]+(?:\s+[A-Z][a-zA-Z\u00C0-\u024F]+)+\.\s+\d{4}[a-z]?\.)")
YEAR_IN_LINE = re.compile(r"^(?=[A-Z]).*\(\d{4}[a-z]?\)")
YEAR_LAST = re.compile(r"[,)]\s*\d{4}[a-z]?\.\n+([A-Z][a-zA-Z\u00C0-\u024F]+(?:[ -][A-Za-z\u00C0-\u024F]+)*[,\s]+(?:[A-Z]\.?\s*)?[A-Z][a-zA-Z\u00C0-\u024F-]+)")
INITIALS_FIRST = re.compile(r"(\.\s*)\n+([A-Z]\.(?:\s*[A-Z]\.)?\s+[A-Z][a-zA-Z\u00C0-\u024F-]+(?:\s+and\s+[A-Z]\.|,\s+[A-Z]\.))")

# DOIs and arXiv identifiers, and how line breaks split them.
DOI_JOINS = [
    (re.compile(r"(10\.\d{4,}/[^\s\]>,]+\.)\s*\n\s*(\d{3,})"), r"\1\2"),
    (re.compile(r"(10\.\d{4,}/[^\s\]>,]+\d)\s*\n\s*(\d+(?:\.\d+)*)"), r"\1\2"),
    (re.compile(r"(10\.\d{4,}/[^\s\]>,]+-)\s*\n\s*(\S+)"), r"\1\2"),
    (re.compile(r"(https?://(?:dx\.)?doi\.org/10\.\d{4,}/[^\s\]>,]+\.)\s*\n\s*(\d+)", re.I), r"\1\2"),
    (re.compile(r"(https?://(?:dx\.)?doi\.org/10\.\d{4,}/[^\s\]>,]+\d)\s*\n\s*(\d[^\s\]>,]*)", re.I), r"\1\2"),
]
DOIS = [re.compile(r"https?://(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s\]>},]+)", re.I), re.compile(r"(10\.\d{4,}/[^\s\]>},]+)")]
ARXIV_JOINS = [(re.compile(r"(arXiv:\d{4}\.)\s*\n\s*(\d+)", re.I), r"\1\2"), (re.compile(r"(arxiv\.org/abs/\d{4}\.)\s*\n\s*(\d+)", re.I), r"\1\2")]
ARXIV_IDS = [re.compile(p, re.I) for p in (
    r"arXiv[:\s]+(\d{4}\.\d{4,5}(?:v\d+)?)", r"arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)", r"arXiv[:\s]+([a-z-]+/\d{7}(?:v\d+)?)", r"arxiv\.org/abs/([a-z-]+/\d{7}(?:v\d+)?)",
)]

# What is no reference, no title, or only a venue.
LINK = re.compile(r"https?\s*:\s*//|ht\s*tps?\s*:\s*//")
TRUSTED = re.compile(r"(acm\.org|ieee\.org|usenix\.org|arxiv\.org|doi\.org)", re.I)
QUOTED_TITLE = re.compile(r"[\u201c\"][^\u201d\"]{8,}[\u201d\"]")
YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
AUTHOR_LISTS = [re.compile(p) for p in (
    r"^[A-Z]{2,}\s*,\s*[A-Z]\.\s*,\s*[A-Z]{2,}\s*,\s*[A-Z]\.",
    r"^[A-Z]{2,}\s*,\s*[A-Z]\.\s*,?\s*AND\s+[A-Z]",
    r"^[A-Z]{2,}\s*,\s*AND\s+[A-Z]\.\s*[A-Z]",
    r"^[A-Z]{2,}\s+[A-Z]{2,}\s+AND\s+[A-Z]\.\s*[A-Z]",
    r"^[A-Z]{2,}\s+AND\s+[A-Z]\.\s*[A-Z]{2,}\s*,",
    r"^[A-Z]\s*[¨´`]\s*[A-Z]+\s*,\s*[A-Z]\.",
    r"^[A-Z]{1,3},\s+[A-Z][a-z]+\s+[A-Z][a-z]+,\s+[A-Z][a-z]+\s+[A-Z][a-z]+",
    r"(?i)^[A-Z]\.(?:\s*[A-Z]\.)?\s+[A-Z][a-z]+,\s+[A-Z]\.(?:\s*[A-Z]\.)?\s+[A-Z][a-z]+,\s+and\s+[A-Z]\.",
)]
VENUES_ONLY = [re.compile(p, re.I) for p in (
    r"^(?:SIAM|IEEE|ACM|PNAS)\s+(?:Journal|Transactions|Review)", r"^(?:Journal|Transactions|Proceedings)\s+(?:of|on)\s+", r"^Advances\s+in\s+Neural",
)]
NO_REFERENCE = [re.compile(p, re.I) for p in (r"^[•\-]\s+(?:The answer|Released models|If you are using)", r"^We gratefully acknowledge")]
VENUE_AFTER_MARK = re.compile(
    r"[?!]\s+(?:International|Proceedings|Conference|Workshop|Symposium|Association|The\s+\d{4}\s+Conference|Nations|Annual|IEEE|ACM|USENIX|AAAI|NeurIPS|ICML|ICLR|"
    r"CVPR|ICCV|ECCV|ACL|EMNLP|NAACL)"
)

# Sentences of a reference. A period after an initial ends none where an author follows.
NO_SENTENCE_END = frozenset("vs eg ie cf fig figs eq eqs sec ch pt no".split())
_S = r"[a-zA-Z\u00A0-\u017F''`´\u2018\u2019\-]"
AUTHOR_FOLLOWS = [re.compile(p) for p in (
    rf"[A-Z]{_S}+\s*,", rf"[A-Z]{_S}+\s+[A-Z][A-Z]?\s*,", r"(?i:and\s+[A-Z])", r"[A-Z]\.", r"[A-Z]\.-[A-Z]\.", rf"[A-Z]{_S}+\.\s+[A-Z]", rf"(?i:[A-Z]{_S}+\s+and\s+[A-Z])",
    rf"[A-Z]{_S}+\s+[A-Z]{_S}+\s*,", r"(?i:(?:von|van|de|del|della|la|le|da|das|dos|der|den|ter|di|du|el|af|ten|op|zum|zur)\s+[A-Z])", rf"[A-Z]{_S}+\s+[A-Z]{_S}+\.",
    rf"[A-Z]{_S}+\.\s+\d", rf"[A-Z]{_S}+\.\s+[A-Z][a-z]+\s+[a-z]", rf"[A-Z]\s+[A-Z]{_S}+\s*,",
)]

# Quotes round titles, and what follows a quoted title.
QUOTED_TO_COMMA = re.compile(r'"(.+),"\s')
QUOTES = [re.compile(p) for p in (
    r'""([^"]+)""', r'["\u201c\u201d]([^"\u201c\u201d]+)["\u201c\u201d]', r'"([^"]+)"', r"[\u2018]([^\u2018\u2019]{10,})[\u2019]", r"(?:^|[\s(])'([^']{10,})'(?:\s*[,.]|\s*$)",
)]
VENUE_STARTS = re.compile(r"^(?:IEEE|ACM|USENIX|In\s+|Proc|Trans|Journal|Conference|Workshop|Symposium|vol\.|pp\.)", re.I)
SUBTITLE_ENDS = [re.compile(p) for p in (
    r"\.\s*[Ii]n\s+", r"\.\s*(?:Proc|IEEE|ACM|USENIX|NDSS|CCS|AAAI|WWW|CHI|arXiv)", r",\s*[Ii]n\s+", r"\.\s*\((?:19|20)\d{2}\)", r"[,\.]\s*(?:19|20)\d{2}", r"\s+(?:19|20)\d{2}\.",
    r"[.,]\s+[A-Z][a-z]+\s+\d+[,\s]", r"\.\s*[A-Z][a-zA-Z]+(?:\s+(?:in|of|on|and|for|the|a|an|&|[A-Za-z]+))+,\s*\d+\s*[,:]",
)]

# By format, what stands before a title and what ends it.
_IN, _LINK_ENDS = r"\.\s*[Ii]n\s+[A-Z]", [r"\s+\((?:19|20)\d{2}\)\s*[,.]?\s*(?:https?://|$)", r"\s+\((?:19|20)\d{2}\)\s*,"]
_MARK_ENDS = [r"[?!]\s+[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014-]+,\s*\d+\s*[(:]", r"[?!]\s+[A-Z][a-z]+\s+(?:[A-Z][a-z]+\s+)?\d+\(", r"[?!]\s+[A-Z][a-z]+\s+[a-z]+\s"]
_YEAR_VENUE = r"\.\s*[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014-]{5,}\s*\((?:19|20)\d{2}\)"


def _ends(*patterns: str) -> list[re.Pattern]:
    return [re.compile(p) for p in patterns]


INITIALS_COLON = re.compile(r"(?:[,\s][A-Z]\.(?:[-–]?[A-Z]\.)*|et\s+al\.)\s*:\s*(.+)")
INITIALS_COLON_ENDS = _ends(
    r"\.\s*[Ii]n:\s+", _IN, r"\.\s*(?:Proceedings|IEEE|ACM|USENIX|NDSS|arXiv)", r"\.\s*(?:Journal|Transactions|Review|Advances)\s+(?:of|on|in)\s+",
    r"\.\s*[A-Z][a-zA-Z\s]+(?:Access|Journal|Review|Transactions)", r"\.\s*[A-Z][a-z]+\s+\d+\s*\(", r"\.\s*https?://", r"\.\s*pp?\.\s*\d+", *_LINK_ENDS,
)
NAME_COLON = re.compile(r"^[A-Z][a-zA-Z\s]+:\s*(.+)")
NAME_COLON_ENDS = _ends(*_LINK_ENDS, r"\.\s*https?://")
ET_AL_FIRST = re.compile(r"^[A-Z]\.\s*et\s+al\.\s*[A-Z][a-zA-Z\u00C0-\u024F-]+\.\s*(.*)", re.S)
ET_AL_FIRST_ENDS = _ends(
    _IN, r"\.\s*(?:Proceedings|IEEE|ACM|USENIX|AAAI|CVPR|ICCV|NeurIPS|ICML|arXiv)", r"\.\s*[Aa]rXiv\s+preprint", r"\.\s*[Aa]dvances\s+in\s+", r"\.\s*https?://",
    r",\s*(?:pages?|pp\.)\s*\d+", r",\s*\d+:\d+", r",\s*\d{4}\.$",
)
YEAR_IN_PARENTHESES = re.compile(r"\(\d{4}[a-z]?\)\.?\s+")
YEAR_IN_PARENTHESES_ENDS = _ends(
    r"\.\s*[Ii]n:\s+", _IN, r"\.\s*(?:Proceedings|IEEE|ACM|USENIX|arXiv)", r"\.\s*[A-Z][a-zA-Z\s]+\d+\s*\(\d+\)", r"\.\s*[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014]+\d+:\d+",
    r"\.\s*[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014-]+,\s*\d+", _YEAR_VENUE, *_MARK_ENDS, r"\s+\[", r"\.\s*https?://", r"\.\s*URL\s+", r"\.\s*Tech\.\s*rep\.", r"\.\s*pp?\.\s*\d+",
)
YEAR_BETWEEN_PERIODS = re.compile(r"\.\s*(?:19|20)\d{2}\.\s+(.*)", re.S)
YEAR_BETWEEN_PERIODS_ENDS = _ends(
    _IN, r"\.\s*(?:Proceedings|IEEE|ACM|USENIX|arXiv)", r"\.\s*[A-Z][a-zA-Z\s&]+\d+\s*\((?:19|20)\d{2}\),\s*\d+", r"\.\s*[A-Z][a-zA-Z\s&]+\((?:19|20)\d{2}\),\s*\d+",
    r"\.\s*[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014-]{10,},\s*\d+", _YEAR_VENUE, *_MARK_ENDS, r"\s+doi:", r"\.\s*https?://", r"\s*\(\d+(?:st|nd|rd|th)?\s*ed\.?\)\.\s*[A-Z]",
)
VENUE_MARKERS = _ends(
    r"\.\s*[Ii]n:\s+(?:Proceedings|Workshop|Conference|Symposium|IFIP|IEEE|ACM)", r"\.\s*[Ii]n:\s+[A-Z]", r"\.\s*[Ii]n\s+(?:Proceedings|Workshop|Conference|Symposium|AAAI|IEEE|ACM|USENIX)",
    r"\.\s*[Ii]n\s+[A-Z][a-z]+\s+(?:Conference|Workshop|Symposium)", r"\.\s*[Ii]n\s+(?:The\s+)?(?:\w+\s+)+(?:International\s+)?(?:Conference|Workshop|Symposium)",
    r"\.\s*(?:NeurIPS|ICML|ICLR|CVPR|ICCV|ECCV|AAAI|IJCAI|CoRR|JMLR),", r"\.\s*arXiv\s+preprint", _IN, r",\s*(?:19|20)\d{2}\.\s*(?:URL|$)", r",\s*(?:19|20)\d{2}\.\s*$",
)
TWO_NAMES = re.compile(r"^[A-Z][a-z]+\s+[A-Z][a-z]+,")
LAST_INITIALS = re.compile(r"(?:,\s+[A-Z]\.(?:[-\s]+[A-Z]\.)*|(?:Jr|Sr|III|II|IV)\.)\s+(.)")
NEXT_AUTHOR = re.compile(r"[A-Z]\.,|[A-Z][a-z]+,")
SURNAME_INITIAL = re.compile(r"^[A-Z][a-z]+,\s+[A-Z]\.")
JOURNAL = re.compile(r"\.\s*([A-Z][^.]+(?:Journal|Review|Transactions|Letters|Magazine|Science|Nature|Processing|Advances)[^.]*),\s*(?:vol\.|Volume|\d+\(|\d+,)", re.I)
JOURNAL_YEAR = re.compile(r"\.\s*([A-Z][A-Za-z\s]+)\s+(?:19|20)\d{2};\d+(?:\(\d+\))?")
CAPITAL_AUTHORS, CAPITAL_AUTHORS_NOT = re.compile(r"^[A-Z]{2,}"), re.compile(r"^[A-Z]{2,}\s+[A-Z](?:,|\s)")
CAPITAL_AUTHORS_TITLE = re.compile(r"\.\s+([A-Z][a-z]*\s+[a-z].*)", re.S)
CAPITAL_AUTHORS_ENDS = _ends(
    _IN, r"\.\s*(?:Proceedings|IEEE|ACM|USENIX|NDSS|arXiv|Technical\s+report)", r"\.\s*[A-Z][a-z]+\s+\d+,\s*\d+\s*\(", r"\.\s*(?:Ph\.?D\.?\s+thesis|Master.s\s+thesis)",
)
COMMA_VENUES = _ends(
    r",\s*arXiv\s+e-prints\s*\(", r",\s*arXiv:\d+",
    r",\s*(?:J\.|Ann\.|Trans\.|Proc\.|Bull\.|Adv\.|Comm\.|Compos\.|Invent\.|Duke|Math\.|Publ\.|Arch\.|Acta|Amer\.|Geom\.|Algebra|Topology)[^,]*\d+\s*\(\d{4}",
    r",\s*[A-Z][a-zA-Z\u00C0-\u017F\s.\'´`]+\d+\s*\(\d{4}", r",\s*IEEE\s+[A-Z][a-zA-Z.\s]+,", r",\s*ACM\s+[A-Z][a-zA-Z.\s]+,", r",\s*Proc\.\s+[A-Z]+",
)
_PARTICLES = "von|van|de|del|della|di|da|dos|das|du|le|la|les|den|der|ten|ter|op|het"
PARTICLES = frozenset(_PARTICLES.split("|")) | {"do"}
AND_AUTHOR = re.compile(rf",?\s+and\s+((?:(?:{_PARTICLES})\s+)*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s*(.+)")
NO_NAMES = frozenset("the a an some their its other more all new one two".split())
AND_NAME = re.compile(rf"^and\s+(?:(?:{_PARTICLES}|do)\s+)*(?:[A-Z]\.?\s*)+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$")
INITIALS_NAME = re.compile(rf"^(?:[A-Z]\.?\s*)+(?:(?:{_PARTICLES}|do)\s+)*[A-Z][a-z]+(?:-[A-Z][a-z]+)*(?:\s+[A-Z][a-z]+)*$")
NAME_WORD = re.compile(r"^(?:[A-Z][a-z]+(?:-[A-Z][a-z]+)*|[A-Z]\.?)$")
INITIALS_LIST = re.compile(r"^([A-Z]\.(?:\s*[A-Z]\.)*\s+[A-Z][a-zA-Z\u00C0-\u024F-]+(?:\s+[A-Z][a-zA-Z\u00C0-\u024F-]+)*,\s*)+")
INITIALS_AUTHOR = re.compile(r"^(?:and\s+)?[A-Z]\.(?:\s*[A-Z]\.)*(?:\s*-\s*[A-Z]\.)*\s+[A-Z][a-zA-Z\u00C0-\u024F-]+(?:\s+[A-Z][a-zA-Z\u00C0-\u024F-]+)*$")
INITIALS_LIST_VENUES = _ends(
    r",\s*(?:Cryptology\s+)?ePrint\s+Archive", r",\s*arXiv(?:\s+preprint)?(?:\s+arXiv)?[:\s]",
    r",\s*(?:Journal|Transactions|Letters|Review|Annals|Archives?|Bulletin|Communications?|Proceedings?)\s+(?:of\s+)?[A-Z]",
    r",\s*[A-Z][a-zA-Z\s&]+(?:Journal|Transactions|Letters|Review|Magazine)", r",\s*(?:IEEE|ACM|SIAM|AMS|Springer|Elsevier|Wiley)\s+", r",\s*(?:in|In):\s+",
    r",\s*(?:in|In)\s+(?:Proc\.|Proceedings|Conference|Workshop|Symposium)", r",\s*(?:Proc\.|Proceedings|Conference|Workshop|Symposium)\s+", r",\s*[A-Z][a-zA-Z.\s]+\d+\s*\(\d+\)\s*\(",
    r",\s*[A-Z][a-zA-Z.\s]+\d+\s*\(\d{4}\)", r",\s*[A-Z][a-zA-Z\s&]+\d+\s*\(\d+\)\s*\(\d{4}\)\s*\d+", r",\s*[A-Z][a-zA-Z\s&]+\d+\s*\(\d{4}\)\s*\d+[–-]",
    r",\s*(?:Technical\s+)?[Rr]eport\s+", r",\s*Ph\.?D\.?\s+[Tt]hesis", r",\s*[A-Z][a-zA-Z\s]+,\s*(?:vol\.|Vol\.|Volume)\s*\d+",
)
AMPERSAND_YEAR = re.compile(r"&\s+[A-Z][a-z-]+,\s+[A-Z]\..*?\(\d{4}\)\.\s+(.*)", re.S)
AMPERSAND_YEAR_ENDS = _ends(r"\.\s+[A-Z][a-z]+(?:\s+[A-Z]?[a-z]+)*,?\s+\d+", r"\.\s+[Ii]n\s+", r"\.\s+(?:http|doi:|arXiv)", r"\.\s+[A-Z][a-z]+:", r"\s+\[", r"\.\s*$")
CAPITAL_INITIAL = re.compile(r"^[A-Z]{2,}\s+[A-Z](?:,|\s|$)")
ET_AL = re.compile(r",?\s+et\s+al\.?\s*[,.]?\s*", re.I)
CAPITAL_NAME = re.compile(r"^[A-Z]{2,}(?:\s+[A-Z])?$")
CAPITAL_INITIAL_ENDS = _ends(
    r"\[J\]", r"\[C\]", r"\[M\]", r"\[D\]", r"\.\s*[A-Z][a-zA-Z\s]+\d+\s*\(\d+\)", r"\.\s*[A-Z][a-zA-Z\s&+]+\d+:\d+", r"\.\s*[A-Z][a-zA-Z\s&+]+,\s*\d+", r"\.\s*(?:19|20)\d{2}",
    r"\.\s*https?://", r"\.\s*doi:",
)

# What a title may still have at its end, in the order in which it is taken off.
MARK_ENDS = _ends(
    r"\?\s*[Ii]n:?\s+(?:[A-Z]|[12]\d{3}\s)", r"[?!]\s+[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014\-]+,\s*\d+\s*[(:]",
    r"[?!]\s+(?:IEEE\s+Trans[a-z.]*|ACM\s+Trans[a-z.]*|Automatica|J\.\s*[A-Z][a-z]+|[A-Z][a-z]+\.?\s+[A-Z][a-z]+\.?)\s+\d+\s*\(",
)
TITLE_CUTS = [re.compile(p, re.I) for p in (
    r"\.\s*[Ii]n:\s+[A-Z].*$",
    r"\.\s*[Ii]n\s+[A-Z].*$",
    r"[.?!]\s*(?:Proceedings|Conference|Workshop|Symposium|IEEE|ACM|USENIX|AAAI|EMNLP|NAACL|arXiv|Available|CoRR|PACM[- ]\w+).*$",
    r"[.?!]\s*(?:Advances\s+in|Journal\s+of|Transactions\s+of|Transactions\s+on|Communications\s+of).*$",
    r"[.?!]\s+International\s+Journal\b.*$",
    r"\.\s*[A-Z][a-z]+\s+(?:Journal|Review|Transactions|Letters|advances|Processing|medica|Intelligenz)\b.*$",
    r"\.\s*(?:Patterns|Data\s+&\s+Knowledge).*$",
    r"[.,]\s+[A-Z][a-z]+\s+\d+[,\s].*$",
    r",\s*volume\s+\d+.*$",
    r",\s*\d+\s*\(\d+\).*$",
    r",\s*\d+\s*$",
    r"\.\s*\d+\s*$",
    r"\.\s*https?://.*$",
    r"\.\s*ht\s*tps?://.*$",
    r",\s*(?:vol\.|pp\.|pages).*$",
    r"\.\s*Data\s+in\s+brief.*$",
    r"\.\s*Biochemia\s+medica.*$",
    r"\.\s*KI-Künstliche.*$",
    r"\s+arXiv\s+preprint.*$",
    r"\s+arXiv:\d+.*$",
    r"\s+CoRR\s+abs/.*$",
    r",?\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:19|20)\d{2}.*$",
    r"[.,]\s*[Aa]ccessed\s+.*$",
    r"\s*\(\d+[–\-]\d*\)\s*$",
    r"\s*\(pp\.?\s*\d+[–\-]\d*\)\s*$",
    r",?\s+\d+[–\-]\d+\s*$",
    r",\s+\d{1,4}[–\-]\d{1,4}\s+https?://.*$",
    r"\.\s*[A-Z][a-zA-Z]+(?:\s+(?:in|of|on|and|for|the|a|an|&|[A-Z]?[a-zA-Z]+))+,\s*\d+\s*[,:]\s*\d+[–\-]?\d*.*$",
    r"\.\s*[A-Z][a-zA-Z\s&+\u00AE\u2013\u2014-]+\d+\s*[(,:]\s*\d+[–\-]?\d*.*$",
    r"\.\s*[A-Z][a-zA-Z\s]+[&+]\s*[A-Z].*$",
    r"\.\s+(?:Beaverton|New\s+York|San\s+Francisco|Cambridge|London|Berlin|Springer|Heidelberg).*$",
    r"\.\s+[A-Z][a-z]+\s+of\s+[A-Z][a-z]+(?:\s+(?:and|&)\s+[A-Z][a-z]+)*\s*$",
    r"\.\s+Foundations\s+and\s+Trends.*$",
    r"\.\s+(?:CHI|CSCW|UbiComp|IMWUT|SOUPS|PETS)\s*['\u2019]?\d{2,4}.*$",
    r",\s+(?:CHI|CSCW|UbiComp|IMWUT|SOUPS|PETS)\s*['\u2019]?\d{2,4}.*$",
)]

# Authors and venues.
SAME_AUTHORS = re.compile(r"^[\u2014\u2013\-]{2,}\s*,")
MOST_AUTHORS, MOST_NAME_WORDS = 15, 5
LOWER_NAME_WORDS = frozenset("and de van von la del di".split())
FOREIGN_LETTER = re.compile(r"[^\W\d_\x00-\x7f]")
VENUE_LEADS = [re.compile(p) for p in (
    r"^[\s\"\u201c\u201d'`,.;:)\]-]+", r"^(?:[.\-]\s*)?[Ii]n:?\s+", r"^\(\s*(?:19|20)\d{2}[a-z]?\s*\)\.?\s*", r"^(?:19|20)\d{2}[a-z]?\.\s*",
    r"(?i)\s*(?:doi\s*:|https?://doi\.org/)\S+.*$", r"(?i)\s*https?://\S+.*$",
)]
VENUE_CUTS = [re.compile(p, re.I) for p in (
    r",\s*vol\.\s*\d.*$", r",\s*no\.\s*\d.*$", r",\s*issue\s+\d.*$", r",\s*pp?\.\s*.*$", r"\.\s*pp?\.\s*.*$", r",\s*pages?\s*.*$", r",\s*\d{1,4}\s*[-\u2013]\s*\d{1,4}.*$",
    r"\s*\(\s*(?:19|20)\d{2}[a-z]?\s*\).*$", r",\s*(?:19|20)\d{2}[a-z]?\.*$", r"\.\s*(?:19|20)\d{2}[a-z]?\.*$",
)]
