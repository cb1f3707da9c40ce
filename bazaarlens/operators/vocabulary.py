"""Words and patterns that titles are read by. They decide results and are stated as they are."""

from __future__ import annotations

LOT_COUNTS = r"\blot\s+of\s+(\d{1,4})\b|\b(\d{1,4})[\s-]*pack\b|\bpack\s+of\s+(\d{1,4})\b|\b(\d{1,4})\s*(?:pcs|pieces|units)\b|\blot\s*\(\s*(\d{1,4})\s*\)"
LOT_WORDS = r"\bjob\s*lot\b|\bbulk\b|\bwholesale\b|\bpallet\b|\blot\b(?!\s+of\s+[a-z])"
LOT_CATEGORIES = ("mixed lots", "bulk lots")
COMPONENTS_MISSING = r"gpu|graphics?\s*card|cpu|processor|mem(?:ory)?|ram|hdd|ssd|drive|storage|os|battery|charger|psu|power\s*supply"
MISSING = rf"\b(?:no|without|missing)\s+(?:{COMPONENTS_MISSING})\b"
BARE = r"\b(console|tablet|handheld|unit|body|head|adapter|card|cpu|gpu|drive)\s*[-:]?\s*only\b|\bonly\s+(console|tablet|handheld|unit|body)\b"
BUNDLE = r"\bbundle\b|\blot\s+includes\b|\bcombo\b"
ACCESSORIES = (
    r"box|case|charger|charging|cable|cord|dock|controller|joy[\s-]?cons?|game|sd\s*card|memory\s*card|adapter|manual|accessor\w*|bag|strap|stand|"
    r"remote|battery|screen\s*protector|hdmi|power\s*supply|grip|carrying"
)
INCLUDES = rf"\b(?:w/|w\s*/|with|inc\.?|incl\.?|includes|including)\s+(?=[^,]*\b(?:{ACCESSORIES})\b)"
PLUS = rf"\+\s*[^,+]*\b(?:{ACCESSORIES})\b"
#: Fixed value: one pattern, stated in its order.
DEFECTS = (
    r"\bfor\s+parts\b|\bparts\s+only\b|\bnot\s+work\w*\b|\bdoes\s*n[o']?t\s+work\b|\bas[\s-]is\b|\bbroken\b|\bcracked?\b|\bchipped\b|\bdamaged?\b|\bfaulty\b|"
    r"\bdefect\w*\b|\bfor\s+repair\b|\bneeds?\s+repair\b|\bspares?\s+or\s+repair\b|\bparts\s+or\s+repair\b|\bparts\s*/\s*repair\b|\bparts\s+read\b|\bread\s+parts\b|"
    r"\bnon[-\s]?functional\b|\bnot\s+functional\b|\bunteste\w+\b|\bdead\b|\bwon'?t\s+(?:power|turn|boot)\b|\bno\s+(?:power|display|video|output|signal|boot|post)\b|"
    r"\bdoes\s*n[o']?t\s+(?:display|post|boot|power)\b|\bbad\s+(?:motherboard|mobo|board|screen|display|battery|port|slot|ram|memory|fan|pcb|lcd|digitizer)\b|"
    r"\bmissing\s+(?:core|vram|die|board|pcb)\b|\bno\s+(?:core|vram|die)\b"
)
CONDITION_DEFECTS = r"for\s+parts|not\s+working|nicht\s+funktionsf|ersatzteil|defekt|ricambio|non\s+funzionante|pi[eè]ces\s+d[eé]tach"
MISSING_AFTER = r"\b(?:gpu|graphics?\s*card|core|vram|die|chip|memory|mem|board|pcb)\b(?:\s*(?:,|and|&|\+)\s*\w+)*\s+(?:is\s+|are\s+)?missing\b"
COMPONENT_CATEGORIES = ("graphics", "video card", "gpu", "processor", "cpu", "memory", "ram", "motherboard")
READ = r"\bread\s*(?:description|desc|details|carefully|first|below|!+)?\b"
NEGATIONS = r"\b(?:no|without|missing|lacks?)\s+(\w+(?:\s+\w+)?)"
CRACK = r"\bcrack(?:s|ed|ing)?\b"
CRACK_DENIED = r"\b(?:no|zero|without|free\s+of|nil)\b[^,|]{0,20}\bcrack(?:s|ed|ing)?\b|\bcrack(?:s|ing)?\s*[-]?\s*free\b"
DOA = r"\bDOA\b|\bdead\s+on\s+arrival\b"
SEALED = r"\bsealed\b|\bbrand\s+new\b|\bbnib\b|\bnib\b|\bnew\s+in\s+box\b|\bunopened\b"
ACCESSORY_NOUNS = (
    r"backplate|back\s?plate|heat\s?sink|cooler|shroud|bracket|water\s?block|nvlink|bridge|riser|mount|manual|guide|sticker|decal|screw|thermal\s?pad|"
    r"cooling\s?fan|fan\s?assembly|replacement\s+part|empty\s+box|box\s+only|paste|standoff|adapter\s+plate|dust\s+cover|anti[\s-]?sag|bezel|face\s?plate|trim\s+piece"
)
STRONG_ACCESSORIES = (
    r"backplates?|back\s?plates?|heat\s?sinks?|shrouds?|water\s*(?:cooling\s+)?blocks?|waterblocks?|nvlink|cooling\s?fans?|fan\s?assembly|thermal\s?pads?|empty\s+box|shell|"
    r"replacement\s+fans?|spare\s+fans?|cooling\s+system|donor|pcb\s+only|core\s+only|die\s+only"
)
# The blanks before a word are bounded here, as this stands in a look-behind of the Java engine, which needs a length.
INCLUSIONS = r"(?:\b(?:with|w/|w\s{0,3}/|includes?|including|comes?\s{1,3}with|plus)\b|\+)"
ONLY_NOUNS = rf"{STRONG_ACCESSORIES}|box|case|cover|packaging|manual|guide|cable|bracket"
PACKAGING = r"\b(?:box|boxed|packaging|wafer|carton)\b"
CONTENTS_ABSENT = r"\b(?:no|without|excludes?)\s+(?:cpu|gpu|processor|graphics\s*card|chip|drive|ssd)\b|\bnot\s+included\b"
FOR = r"\bfor\b|\breplacement\b|\bassembly\b"
NOT_THE_PRODUCT = r"\bno\s+(?:graphics?\s+card|gpu|video\s+card|console|phone|device|pcb|board)\b"
SUBJECTS = r"^\W*(?:case|box|cover|skin|sleeve|bag|shell|stand|holder|dock|pcb)\b"
CONSOLE_ACCESSORY = r"\b(?:nintendo\s+)?switch(?:\s*2)?(?:\s+(?:oled|lite))?\s+(dock|docking\s+station|joy[\s-]?cons?|pro\s+controller|charging\s+(?:dock|stand|grip))\b"
CAPACITY = r"\b(\d{1,5})\s*(GB|TB)\b"
# One group holds the whole list of numbers, which is split at its slashes afterwards.
SHARED_UNIT = r"\b(\d{1,4}(?:\s*/\s*\d{1,4})+)\s*(GB|TB)\b"
KIT_COUNT_FIRST, KIT_SIZE_FIRST = r"\b(\d{1,2})\s*[xX]\s*(\d{1,5})\s*(GB|TB)\b", r"\b(\d{1,5})\s*(GB|TB)\s*[xX]\s*(\d{1,2})\b"
GENERATION = r"\b(DDR[345])\b|\bPCIe?\s*(?:Gen\s*)?([345])(?:\.0)?\b|\bGen\s*([345])(?:\.0)?\b"
STORAGE_WORDS = r"\b(?:RAM|memory|DIMM|SODIMM|SSD|HDD|NVMe|SATA|M\.?2|drive|DDR[345]|PC[45]-\d|storage|hard\s?disk)\b"
FORM_FACTORS = (
    ("server", r"\b(?:ECC|RDIMM|LRDIMM|registered|server)\b"), ("laptop", r"\b(?:SODIMM|SO-DIMM|laptop|notebook)\b"), ("m.2", r"\bM\.?2\b|\b22\d{2}\b"),
    ("2.5in", r"\b2\.5\s*(?:\"|''|inch\b|in\b)"), ("desktop", r"\b(?:UDIMM|DIMM|desktop)\b"),
)
GPU = r"\b(RTX|GTX|RX)[^\w\s]*\s*-?\s*(\d{3,4})\s*(Ti\s*SUPER|Ti|XTX|XT|SUPER)?\b"
CPU_WORDS = r"\b(?:ryzen|threadripper|core\s+i[3579]|intel\s+core|processor|cpu)\b"
CPU_INTEL = r"\b(i[3579])[\s-]*(\d{4,5})([A-Z]{0,2})\b"
CPU_AMD = r"\bryzen\s+(?:\d\s+)?(\d{4})\s*(x3d|xt|x|g|ge)?\b|\b(\d{4})(x3d|xt|x|g)\b(?=.*\bryzen\b)"
CONSOLE = r"\b(?:nintendo\s+)?switch\s*(2)\b|\b(?:nintendo\s+)?switch\s+(oled|lite)\b|\b(oled|lite)\s+(?:nintendo\s+)?switch\b|\b(?:nintendo\s+)?(switch)\b|\bplaystation\s*(5|4)\b|\bps\s*(5|4)\b|\bxbox\s+series\s*([sx])\b|\bxbox\s+(one)\b"
PLATFORM_CATEGORIES = ("video games", "game cases", "memory cards", "accessor")
PHONE = (
    r"\biphone\s*\(?(\d{1,2})\)?\s*(e)\b|\biphone\s*\(?(\d{1,2})\)?\s*(pro\s*max|pro|plus|mini|max)?\b|\biphone\s+(se\s*\d?|air|xs\s*max|xr|xs|x)\b"
    r"|\bgalaxy\s+([sznf])\s*(\d{1,2})\s*(ultra|plus|\+|fe)?\b|\bpixel\s+(\d{1,2})\s*(pro\s*xl|pro|xl|a)?\b"
)
MACHINES = r"\b(?:pc|computer|workstation|desktop|barebones|tower|server|laptop|notebook|rig|build|system)\b"
ACCESSORY_CATEGORIES = ("cooling", "parts", "accessor", "cases, covers", "covers & skins", "charger", "attachment", "cable", "adapter", "mount", "bracket", "tools", "travel cases", "bags, skins", "game cases", "memory cards")
VARIANTS = r"\ball\s+colou?rs?\b|\b(?:choose|pick|select)\b[^,]{0,24}\b(?:colou?r|storage|capacity|size|model|variant)\b|\byour\s+choice\b|\ball\s+sizes\b|\bmultiple\s+(?:sizes|colou?rs|options)\b"
MACHINE_CATEGORIES = ("pc desktops", "laptops", "netbooks", "computer servers", "motherboard & cpu", "all-in-ones")
ONE_CAPACITY_CATEGORIES = ("cell phones", "smartphones", "consoles", "tablets")
COLOURS = (
    r"black|white|gold|silver|blue|red|green|pink|purple|yellow|gray|grey|rose|graphite|midnight|starlight|titanium|orange|lavender|coral|teal|"
    r"violet|bronze|copper|cream|beige|navy|mint"
)
COLOUR_LIST = rf"\b(?:{COLOURS})\b\s*/\s*(?:{COLOURS})\b\s*/\s*(?:{COLOURS})\b"
PHONE_CATEGORIES = ("cell phones", "smartphones", "mobile phones")
MAX_CAPACITY_GB, MAX_MODULES = 100_000, 8
