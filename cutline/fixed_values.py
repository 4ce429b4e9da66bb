"""Fixed values.

Everything in this module is data whose exact spelling decides whether results
are right: enumerations, word lists, lookup tables, URLs, thresholds, message
texts and file formats.  No logic lives here.
"""

# --- enumerations, in their fixed order ------------------------------------

BRANDS = ("VW", "Audi", "Skoda", "Seat", "Cupra", "Porsche", "Bentley", "Lamborghini")
PRIORITIES = ("Unknown", "Low", "Medium", "High")
STATUSES = ("Downloaded", "MetadataOnly", "Failed", "NotImplemented")
CONFIDENCES = ("High", "Heuristic", "Unparsed")
OUTCOMES = ("Completed", "DiscoveryFailed", "NotImplemented")
ISSUE_KINDS = (
    "BodyTypeLooksLikeYear",
    "FuelTypeIsBareDigits",
    "DuplicateId",
    "BrandEntirelyUnknownPriority",
    "BrandUnknownPriorityCountAboveBaseline",
)

# --- thresholds and sizes ----------------------------------------------------

HIGH_THRESHOLD = 100_000
MEDIUM_THRESHOLD = 20_000
UNKNOWN_BASELINES = (("Porsche", 19),)
NOTE_WIDTH = 40
HEADER_WINDOW = 200
HEADER_SEARCH_ROWS = 20
PREVIEW_ROWS = 15
PREVIEW_COLUMNS = 8

# --- brand labels as statistics spell them (Cupra is counted under SEAT) -----

BRAND_LABELS = (
    ("VW", "VW"),
    ("VW", "VOLKSWAGEN"),
    ("Audi", "AUDI"),
    ("Skoda", "SKODA"),
    ("Skoda", "ŠKODA"),
    ("Seat", "SEAT"),
    ("Cupra", "CUPRA"),
    ("Cupra", "SEAT"),
    ("Porsche", "PORSCHE"),
    ("Bentley", "BENTLEY"),
    ("Lamborghini", "LAMBORGHINI"),
)

# --- model aliases: brand, model name, series name in the statistics ---------

MODEL_ALIASES = (
    ("VW", "ID.3", "ID.3"),
    ("VW", "ID.4", "ID.4, ID.5"),
    ("VW", "ID.5", "ID.4, ID.5"),
    ("VW", "T-Roc", "T-ROC"),
    ("VW", "T-Cross", "T-CROSS"),
    ("Porsche", "911 Carrera", "911"),
    ("Porsche", "911 G-Model", "911"),
    ("Porsche", "911 Targa 4", "911"),
    ("Porsche", "911 Urmodell", "911"),
    ("Porsche", "964", "911"),
    ("Porsche", "993", "911"),
    ("Porsche", "996", "911"),
    ("Porsche", "986", "BOXSTER"),
    ("Porsche", "Cayenne E-Hybrid", "CAYENNE"),
    ("Porsche", "Cayenne S E-Hybrid", "CAYENNE"),
    ("Porsche", "Cayenne S Hybrid", "CAYENNE"),
    ("Porsche", "Panamera S E-Hybrid", "PANAMERA"),
    ("Porsche", "Panamera S Hybrid", "PANAMERA"),
    ("Porsche", "Panamera Sport Turismo", "PANAMERA"),
    ("Porsche", "Taycan Cross Turismo", "TAYCAN"),
    ("Bentley", "NEW CONTINENTAL GT", "CONTINENTAL"),
    ("Bentley", "NEW CONTINENTAL GT CONVERTIBLE", "CONTINENTAL"),
    ("Bentley", "NEW CONTINENTAL GTC", "CONTINENTAL"),
    ("Lamborghini", "Urus SE", "URUS"),
)

# --- sibling groups: group id, platform, members (brand, model name) ---------

SIBLING_GROUPS = (
    ("mqb-a0-polo-family", "MQB A0",
     (("VW", "Polo"), ("Seat", "Ibiza"), ("Skoda", "Fabia"))),
    ("mqb-golf-family", "MQB",
     (("VW", "Golf"), ("Seat", "Leon"), ("Skoda", "Octavia"), ("Audi", "A3"))),
    ("mqb-a0-compact-suv-family", "MQB A0",
     (("VW", "T-Roc"), ("VW", "Taigo"), ("Seat", "Arona"), ("Skoda", "Kamiq"))),
    ("mqb-evo-midsize-suv-family", "MQB Evo",
     (("VW", "Tiguan"), ("Seat", "Ateca"), ("Cupra", "Ateca"), ("Skoda", "Karoq"))),
    ("mqb-evo-large-suv-family", "MQB Evo (7-Sitzer)",
     (("VW", "Tayron"), ("Seat", "Tarraco"), ("Cupra", "Terramar"), ("Skoda", "Kodiaq"))),
    ("mqb-passat-family", "MQB (Mittelklasse Kombi/Limousine)",
     (("VW", "Passat"), ("Skoda", "Superb"), ("Audi", "A4"))),
    ("meb-compact-family", "MEB (vollelektrisch, kompakt)",
     (("VW", "ID.3"), ("Cupra", "Born"))),
    ("meb-suv-family", "MEB (vollelektrisch, SUV)",
     (("VW", "ID.4"), ("Skoda", "Enyaq"), ("Audi", "Q4"))),
)

# --- word lists --------------------------------------------------------------

PORSCHE_BODY_TYPES = (
    "Sport Turismo", "Stationwagon", "Hardtop-Cabriolet", "Convertible-D (Hardtop)",
    "Cabriolet", "Roadster", "Convertible", "Coupé", "Coupe", "Targa", "Spyder",
    "Saloon", "Sedan", "SUV",
)
SKODA_BODY_TYPES = ("Combi", "Sedan", "Pick Up", "SUV")
SKODA_FUEL_TYPES = ("PHEV HYBRID", "MHEV", "CNG", "LPG", "Hybrid", "GD")
SKODA_ELECTRIC_BADGE = "iV"
KNOWN_TYPOS = (("Boxter", "Boxster"),)

# --- landed pages and markers on them ----------------------------------------

PAGE_URLS = {
    "VW": "https://assets.feature-app.io/rescue-asset/vw-de/config/rescueEntries.json",
    "Audi": "https://www.audi.com/en/information-on-accident-rescue-17123",
    "Skoda": "https://www.skoda-auto.de/service/rettungskraefte",
    "Seat": "https://www.seat.de/kontakt/downloads/rettungsblaetter",
    "Cupra": "https://www.cupraofficial.ch/de/services/rettungsblaetter",
    "Porsche": "https://www.porsche.com/international/accessoriesandservice/porscheservice/vehicleinformation/documents/",
    "Bentley": "https://www.bentleymotors.com/en/pages/other-vehicle-information.html",
    "Lamborghini": "https://www.lamborghini.com/en-en/guide-for-emergency-responders",
}
STOCK_PAGE_URL = "https://www.kba.de/DE/Statistik/Produktkatalog/produkte/Fahrzeuge/fz12_b_uebersicht.html"
STOCK_HOST = "https://www.kba.de"
STOCK_LINK_CLASS = "c-publication"
STOCK_LINK_PREFIX = "fz12_"
STOCK_LICENSE = "Datenlizenz Deutschland - Namensnennung - Version 2.0 (dl-de/by-2-0)"

GERMAN = "DE"
ENGLISH = "EN"
GERMAN_BUCKET_MARK = ".DE"
GERMAN_BUTTON_LABEL = "DEUTSCHE"
BENTLEY_ITEM_CLASS = "bm-m-accordion__item"
BENTLEY_TITLE_CLASS = "bm-m-accordion__item-title"
BENTLEY_LABEL_CLASS = "bm-e-button__label"
SEAT_GUIDE_HREF = "emergency-response-guide-de.pdf"
SEAT_GUIDE_NAME = "General Guide"
SEAT_GUIDE_LABEL = "seat-emergency-response-guide-de.pdf"
SEAT_MODEL_CLASS = "link-arrow"
SEAT_MODEL_HREF = "/rettungsblaetter/"
SKODA_OVERVIEW_MODULE = "OneColumnText"
SKODA_MODEL_MODULE = "download-file"
SKODA_MODEL_HREF = "rettungsdatenblatt-"
COMBINED_PREFIX = "Rescue Data Sheets"
COMBINED_NAME = "All Models"
COMBINED_CLASSIC_NAME = "All Models Classic"
COMBINED_CLASSIC_MARK = "Classic"
HEADER_MARKER = "Porsche AG,"

# --- stock sheet layout ------------------------------------------------------

SHEET_NAME = "FZ 12.1"
SHEET_PREFIX = "FZ 12"
SHEET_SEGMENT_TITLE = "Segment"
SHEET_SERIES_TITLE = "Modellreihe"
SHEET_END_MARKER = "BESTAND INSGESAMT"

# --- message texts (%s placeholders follow Spark's format_string) ------------

TEXT_NO_URL = "No download URL discovered"
TEXT_DRY_RUN = "dry-run: download skipped"
TEXT_HTTP_STATUS = "HTTP %s %s"
TEXT_CONTENT_TYPE = "Unexpected Content-Type '%s' instead of PDF (possibly an auth-gateway redirect)"
TEXT_TIMEOUT = "Timeout: %s"
TEXT_NO_SOURCE = "No source registered for this brand."
TEXT_NOTE_NOT_IMPLEMENTED = "not implemented"
TEXT_NOTE_DISCOVERY_FAILED = "discovery failed"
TEXT_BODY_YEAR = "BodyType '%s' looks like a year or year range, not a body style - probably a shifted field."
TEXT_FUEL_DIGITS = "FuelType '%s' is just digits, not a fuel/drivetrain description - probably a shifted field."
TEXT_DUPLICATE_ID = "Id '%s' appears %s times in this dataset."
TEXT_BRAND_UNKNOWN = (
    "Every one of %s %s cards has BundlePriority.Unknown, even though other brands in this dataset matched "
    "real KBA stock rows - likely a brand-matching gap (e.g. a missing BrandNames alias), not genuinely "
    "100%% untracked models."
)
TEXT_ABOVE_BASELINE = (
    "%s has %s cards with BundlePriority.Unknown, more than the expected baseline of %s - a newly unmatched "
    "model may need a model-aliases.json entry, or an existing alias broke."
)
TEXT_NO_SHEET = "No '%s' worksheet found in the FZ12 %s file - the layout has likely changed."
TEXT_EMPTY_SHEET = "Worksheet '%s' in the FZ12 %s file is empty."
TEXT_NO_HEADER = "Header row ('Segment'/'Modellreihe') not found in FZ12 %s - the layout has likely changed."
TEXT_HEADER_YEAR = "The count column header ('%s') does not contain the expected year %s."
TEXT_NOT_A_NUMBER = "Row %s: count for '%s' is not a number ('%s') - skipped."
TEXT_NO_STOCK_LINK = "No download link for FZ12 %s found on the KBA product page."
TEXT_STOCK_FORMAT = (
    "FZ12 %s is not available in XLSX format (%s) - older formats (.xls/.pdf) are not currently supported."
)

# --- file formats ------------------------------------------------------------

REPORT_CSV_HEADER = "Brand,ModelName,CardCount,NotDownloadedCount,EstimatedFleetSize,BundlePriority"
BYTE_ORDER_MARK = "\ufeff"
