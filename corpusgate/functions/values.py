"""Word lists, units and formats that decide results.

They are data, not logic: every list below is a default that the operators accept as a
parameter. Patterns are assembled from these lists where they are used.
"""

# ---- note layout -------------------------------------------------------------------
# Separator and names of the packed note fields.
FIELD_SEP = "\x1f"
FIELD_NAMES = ("Text", "Extra", "Personal Notes", "Custom",
               "Missed Questions", "Textbook", "Additional Resources")
NOTE_FIELDS = ("text", "extra", "personal", "custom", "missed", "textbook", "resources")

# ---- terms and topics ----------------------------------------------------------------
# Words that never count as a content term.
STOP_WORDS = tuple("""
the a an of in is to and for with by that this it as on at from or be which
its during when if not are was were has have had can may must should would there their
they them then than these those what who how why where such other more most some any
each both all than into onto upon about after before between within without also very
often used using use provides provide following follows given give gives
""".split())
STOP_WORDS_INVENTORY = STOP_WORDS + ("card", "cards")

# Short forms and their long forms, expanded in this order.
ABBREVIATIONS = (
    ("last", "local anesthetic systemic toxicity"),
    ("cns", "central nervous system"),
    ("cv", "cardiovascular"),
    ("tlf", "thoracolumbar fascia"),
    ("tap", "transversus abdominis plane"),
    ("ql", "quadratus lumborum"),
    ("esp", "erector spinae plane"),
    ("pvb", "paravertebral block"),
    ("pvs", "paravertebral space"),
    ("sap", "serratus anterior plane"),
    ("asis", "anterior superior iliac spine"),
    ("copd", "chronic obstructive pulmonary disease"),
    ("map", "mean arterial pressure"),
    ("gfr", "glomerular filtration rate"),
    ("ffp", "fresh frozen plasma"),
    ("vwf", "von willebrand factor"),
    ("pdph", "post dural puncture headache"),
    ("iim", "internal intercostal membrane"),
    ("eom", "external oblique muscle"),
    ("iom", "internal oblique muscle"),
    ("tam", "transversus abdominis muscle"),
)

# Units that make a number a fact (topics, then corpus inventory).
TOPIC_UNITS = ("mg/kg", "mcg/kg", "mg", "mcg", "kg", "ml", r"l\b", "cm", "mm", "gauge",
               "mhz", r"ma\b", "%", "hours", "hour", "minutes", "min", "degrees")
TOPIC_UNIT_ALIASES = (("l", "ml"), ("hour", "hours"), ("min", "minutes"))
INVENTORY_UNITS = ("mg/kg", "mcg/kg", "mg", "mcg", "kg", "mL", "L", "cm", "mm", "gauge",
                   "MHz", "mA", "%")

# ---- structural checks -----------------------------------------------------------------
# Units that must stay outside a cloze answer (ledger form, audit form).
LEDGER_CLOZE_UNITS = ("mg", "mcg", "ml", "mL", "cm", "mm", "kg", "g", "%", "mmHg",
                      "cmH2O", "psi", "mA", "Hz", "Fr")
AUDIT_CLOZE_UNITS = ("mL", "mg", "kg", "mcg", "cm", "mm", "MHz", "mA", "gauge", "Hz")
LEDGER_DOSE_UNITS = ("mg", "mcg", "ml", "mL", "kg", "%")
LEDGER_EXEMPT_ABBREVIATIONS = ("IO", "NCE")
AUDIT_EXEMPT_ABBREVIATIONS = ("ASIS", "TLF", "PVS", "IIM", "TAP", "QL")
LEDGER_ATTRIBUTIONS = ("per the module", "the module states", "the lecture", "as taught in",
                       "according to the (?:course|source|module)")
LEDGER_CERTAINTY = ("always", "never", "exactly", "precisely", "consistently")
LEDGER_DIRECTIONS = ("medial", "lateral", "cephalad", "caudad", "superficial", "deep",
                     "anterior", "posterior", "proximal", "distal")
PRESENTATION_TAGS = ("b", "i", "u", "em", "strong", "span", "font", "small", "big", "sub",
                     "sup")
LINE_END_TAGS = ("div", "p", "li", "tr")
LAYOUT_TAGS = ("div", "p", "ul", "ol", "table", "tbody", "tr", "td", "th")

# ---- attribution -----------------------------------------------------------------------
# Wording that names a source.
SOURCE_NOUNS = ("the module", "this module", "the lecture", "the textbook",
                "the course material", "the source module")
SOURCE_LEADS = ("according to", "based on", "per",
                r"as (?:taught|described|stated|presented|noted|defined)(?:\s+(?:in|by))?",
                "cited in", "in", "from")
SOURCE_VERBS = ("states?", "says?", "notes?", "lists?", "ranks?", "describes?",
                "emphasi[sz]es", "teaches", "defines?", "reports?", "claims?", "considers?",
                "recommends?", "specifies", "indicates?", "classifies", "distinguishes",
                "groups?", "calls?", "places?", "prefers?", "suggests?", "mentions?",
                "stresses", "uses?")
SOURCE_ARTEFACTS = ("module", "text", "textbook", "chapter", "course", "curriculum",
                    "material", "content")
BRAND_QUIET_AFTER = ("of", "beat", "impulse", "cordis", "region", "sign", "line")
BRAND_QUIET_BEFORE = ("iliac", "the", "a", "an", "anterior", "posterior", "superior",
                      "inferior", "medial", "lateral")

# ---- claims ------------------------------------------------------------------------------
# Nouns a claim can be about.
HEAD_NOUNS = tuple("""
block nerve muscle artery vein ligament space fascia plane membrane
process sheath groove joint approach technique catheter needle probe
transducer injection line border margin dermatome root ramus rami plexus
tube blade cuff mask airway laryngoscope bougie stylet scope balloon
cannula cricothyrotomy tracheostomy intubation ventilation
valve vaporizer vaporiser flowmeter circuit absorber canister ventilator
cylinder regulator alarm monitor sensor analyzer analyser scavenger
manifold bellows hose connector filter humidifier blender
drug agent receptor channel agonist antagonist blocker inhibitor
pressure volume flow rate dose concentration gradient capacity resistance
compliance threshold ratio coefficient clearance half-life onset duration
temperature output saturation
syndrome reflex sign test scale index curve score grade class stage phase
""".split())
TECHNIQUE_NOUNS = ("block", "approach", "technique", "injection", "catheter", "needle",
                   "probe", "transducer", "line", "test", "scale", "index", "curve")
PROCEDURE_NOUNS = ("block", "approach", "technique", "injection", "intubation",
                   "ventilation", "cricothyrotomy", "tracheostomy")
QUANTITY_NOUNS = ("pressure", "volume", "flow", "rate", "dose", "concentration", "gradient",
                  "capacity", "resistance", "compliance", "threshold", "ratio",
                  "coefficient", "clearance", "onset", "duration", "temperature", "output",
                  "saturation", "line", "margin", "border", "score", "grade", "class",
                  "stage", "phase")
# Words dropped from a subject phrase.
QUALIFIERS = tuple("""
a an the this that each every any single one two
landmark ultrasound ultrasound-guided guided continuous shot
single-shot classic standard conventional modified bilateral
unilateral successful failed typical primary main correct
initial final same his her their its our your my
of for with in on at to and or is are be
performing during when after before using targeted target
from through into between within along near toward
towards under over below above by across onto past
beyond around against up down out
""".split())
FUNCTION_WORDS = tuple("""
alongside because since although while where which whose
there here then than also both either neither such
these those some many most more less other another
given named called known seen found used made via
""".split())
POSITIONAL = tuple("""
thoracic lumbar cervical sacral abdominal posterior anterior
lateral medial superior inferior deep superficial proximal
distal internal external innermost left right upper lower
greater lesser long short transverse spinous
""".split())
LEADING_VERBS = tuple("""
contact reach encounter advanc insert redirect withdraw identify visuali[sz]e
palpate locate find enter exit pierce puncture traverse cross block inject
deposit plac position scan align rotat slid target avoid reveal show
display form cover supply innervate arise emerge divide give run travel
course lie sit rest pass is are be was were has have had
""".split())
ROMAN = (("i", "1"), ("ii", "2"), ("iii", "3"), ("iv", "4"), ("v", "5"))
REGIONS = ("thoracic", "lumbar", "cervical", "sacral", "pediatric", "paediatric")
PREPOSITIONS_BEFORE = tuple("""
from through into between within along near toward towards under over
below above across onto past beyond around against at in of by for with on during
""".split())
PREPOSITIONS_LEADING = tuple("""
from through into between within along near toward towards under over
below above across onto past beyond around against at in of by for with on
""".split())

# Attribute cues, tried in this order.
ATTRIBUTE_CUES = (
    ("total", (r"\btotals?\b", "cumulative", "combined", "altogether", "in all",
               "across (?:the|both|all)")),
    ("volume-increment", (r"increments?\b", r"aliquots?\b", "divided doses")),
    ("distance-from-midline", ("from the mid ?line", "lateral to the (?:mid ?line|spinous)",
                               "lateral to the spinous process")),
    ("advancement", (r"advanc\w+", r"walk\w* off", "past the", "further", "deeper",
                     "beyond the")),
    ("depth-to-landmark", ("depth of", r"contact\w*", "at a depth", r"encounter\w*",
                           r"reach\w+", "is (?:met|found) at", "lies at", "located at")),
    ("needle-length", ("needle (?:length|is|of)", "length is", "cm needle", "inch needle",
                       "mm needle", "needle measur")),
    ("volume-per-level", ("per level", "at each level", "per side", "per injection")),
    ("volume", ("volume", r"inject\w*", "bolus", "hydrodissect", r"deposit\w*")),
    ("probe-position", ("transducer", "probe", r"scan\w*")),
)
# Units that follow a measured value, longest forms first.
CLAIM_UNITS = ("cmH2?O", "cm ?H2O", "mmHg", "kPa", "psi", r"bar\b",
               "L/min", "liters?/min", "litres?/min", "mL/min", "mL/kg/min",
               "mL/kg", "mg/kg", "mcg/kg", "micrograms?/kg", "mg/mL", "mcg/mL",
               "mL", "milliliters?", "mg", "mcg", "micrograms?", r"L\b",
               "cm", r"centimet\w+", "mm", r"millimet\w+", "inch(?:es)?", "gauge", "mA",
               "MHz", "%", "degrees?")
# Unit to measured family, and length units in millimetres.
UNIT_FAMILIES = (
    ("ml", "volume"), ("milliliter", "volume"), ("milliliters", "volume"),
    ("ml/kg", "dose-volumetric"),
    ("mg/kg", "dose-mass"), ("mcg/kg", "dose-mass"), ("micrograms/kg", "dose-mass"),
    ("microgram/kg", "dose-mass"),
    ("mg", "mass"), ("mcg", "mass"), ("micrograms", "mass"), ("microgram", "mass"),
    ("cm", "length"), ("centimeter", "length"), ("centimeters", "length"),
    ("centimetre", "length"), ("centimetres", "length"),
    ("mm", "length"), ("millimeter", "length"), ("millimeters", "length"),
    ("millimetre", "length"), ("millimetres", "length"),
    ("inch", "length"), ("inches", "length"),
    ("gauge", "gauge"), ("ma", "current"), ("mhz", "frequency"),
    ("%", "percent"), ("degree", "angle"), ("degrees", "angle"),
    ("cmh2o", "pressure"), ("cm h2o", "pressure"), ("cmho", "pressure"),
    ("mmhg", "pressure"), ("kpa", "pressure"), ("psi", "pressure"), ("bar", "pressure"),
    ("l/min", "gas-flow"), ("liter/min", "gas-flow"), ("liters/min", "gas-flow"),
    ("litre/min", "gas-flow"), ("litres/min", "gas-flow"), ("ml/min", "gas-flow"),
    ("ml/kg/min", "gas-flow"), ("l", "volume"),
    ("mg/ml", "concentration"), ("mcg/ml", "concentration"),
)
MILLIMETRES = (
    ("cm", 10.0), ("centimeter", 10.0), ("centimeters", 10.0), ("centimetre", 10.0),
    ("centimetres", 10.0), ("mm", 1.0), ("millimeter", 1.0), ("millimeters", 1.0),
    ("millimetre", 1.0), ("millimetres", 1.0), ("inch", 25.4), ("inches", 25.4),
)
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
                "ten", "eleven", "twelve")
COUNTABLES = ("layers?", "levels?", "branches?", "leaves", "leaflets?", "divisions?",
              "segments?", "dermatomes?", "compartments?", "heads?")
CHECKABLE_HEADS = ("distance-from-midline", "depth-to-landmark", "advancement",
                   "needle-length", "volume", "volume-per-level", "volume-increment",
                   "probe-position", "spinal-level", "percent", "count", "gauge", "angle",
                   "dose-mass", "dose-volumetric", "current", "frequency", "length", "mass")
# Measured families that the survey adds to them (T11).
CHECKABLE_FAMILIES = ("total", "pressure", "gas-flow", "concentration")
INSTRUMENT_HEADS = ("needle-length", "gauge", "needle-type")
# Contrast families and the context word each one needs ("" = none).
FAMILIES = (
    ("needle-type", ("tuohy", "quincke", "b-bevel", "blunt", "pencil-point", "whitacre",
                     "sprotte", "echogenic", "hypodermic")),
    ("needle-direction", ("medial to lateral", "lateral to medial", "cephalad to caudad",
                          "caudad to cephalad", "in-plane", "out-of-plane")),
    ("body-position", ("supine", "prone", "lateral decubitus", "sitting", "standing")),
    ("limb-position", ("at the side", "abducted", "adducted", "externally rotated",
                       "forward", "overhead", "flexed", "extended")),
)
POSITION_CONTEXT = r"position\w*|patient is|placed|lying|lies|arm\b"
NEEDLE_CONTEXT = "needle|catheter"
# Detector wording for directions, procedure verbs, drugs, contrast, certainty.
DIRECTION_WORDS = ("medial(?:ly)?", "lateral(?:ly)?", "cephalad", "caudad", "cranial(?:ly)?",
                   "caudal(?:ly)?", "superficial(?:ly)?", "anterior(?:ly)?",
                   "posterior(?:ly)?", "superior(?:ly)?", "inferior(?:ly)?", "in-plane",
                   "out-of-plane", "clockwise", "counter-?clockwise")
PROCEDURE_VERBS = (r"advanc\w+", r"insert\w+", r"redirect\w+", r"withdraw\w+", "angled?",
                   r"tilt\w*", r"aim\w*", r"direct\w+", r"walk\w* off", r"thread\w*",
                   "puncture[ds]?", r"pierc\w+", r"inject\w*", r"position\w*", "placed?",
                   r"slid\w+", r"rotat\w+", r"approach\w*", r"orient\w*")
DRUG_NAMES = (r"\w*caine", r"\w*fentanil", r"\w*curium", r"\w*onium", "midazolam",
              "diazepam", "lorazepam", "ketamine", "propofol", "etomidate",
              "dexmedetomidine", "succinylcholine", "rocuronium", "vecuronium",
              "epinephrine", "adrenaline", "norepinephrine", "phenylephrine", "ephedrine",
              "neostigmine", "sugammadex", "glycopyrrolate", "atropine", "clonidine",
              "dexamethasone", "morphine", "hydromorphone", "ketorolac", "acetaminophen",
              "heparin", "protamine", "tranexamic")
WEIGHT_DOSE_UNITS = ("mg", "mcg", "micrograms?", "mL")
CONTRAST_PHRASES = ("discriminator", "contrast", "corresponding figure",
                    "compared (?:with|to)", "whereas", "unlike", "as opposed to",
                    "rather than", "the other", "counterpart", "elsewhere in")
COMPARATIVES = ("higher", "lower", "shorter", "longer", "larger", "smaller", "deeper",
                "shallower", "greater", "wider", "narrower", "fewer", "more")
CERTAINTY_WORDS = ("exactly", "precisely", "perfectly", "strictly", "absolutely",
                   "consistently", "always", "never", "guarantee[sd]?", r"invariabl\w+")

# ---- pages and boxes -----------------------------------------------------------------------
# Page-reading limits.
CONFIDENCE_OK = 60.0
BAND_GAP = 18
BAND_PAD = 10
SEPARATOR_PX = 6
MAX_BANDS = 40
FURNITURE_LIMIT = 0.15
SHEET_LIMIT = 0.85
TOKEN_PX = 28
STRIP_SIZE = 1600
STRIP_OVERLAP = 120
BOX_UNITS = ("mg", "mcg", "ug", "ml", "mL", "cc", "cm", "mm", "kg", "kPa", "mmHg", "cmH2O",
             "psi", "mA", "Hz", "Fr", "ga", "%")

# ---- sources and registry --------------------------------------------------------------------
# Accepted files, ledgers, orders.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp")
TEXT_EXTENSIONS = ("txt", "md", "csv", "rtf")
SOURCE_EXTENSIONS = ("pdf",) + IMAGE_EXTENSIONS + TEXT_EXTENSIONS
NOISE_WORDS = ("module", "deck")
APPLIED_KINDS = ("EDIT", "REWRITE", "SPLIT", "DEMOTE", "DELETE")
CHANGELOG_ORDER = ("DEMOTE", "DELETE", "SPLIT", "REWRITE", "EDIT", "ADD", "DUPE-SKIP", "SKIP")
REVIEW_KINDS = ("DEMOTE", "DELETE", "SPLIT")
STATUS_ORDER = ("in-progress", "built-unverified", "pending", "verified")

# Fixed: how the reason of an applied split tells its number of parts.
SPLIT_MARK = (" -> ", " atomic notes")
SPLIT_COUNT = r"-> ([0-9]+) atomic"
