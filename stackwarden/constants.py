"""Fixed values. They decide results, so they are stated as they are, in their natural order."""

# --- file extensions (fixed values) -------------------------------------------------------------
IMAGE_EXTS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "heic", "heif", "tiff", "tif"]
DOC_EXTS = ["pdf", "docx", "xlsx"]
VIDEO_EXTS = ["mp4", "mov", "mkv", "avi", "webm", "m4v", "3gp", "wmv", "flv"]
SCAN_EXTS = IMAGE_EXTS + DOC_EXTS + VIDEO_EXTS
# clustering and learning leave heif out; classification and learning also leave videos out
GROUPING_IMAGE_EXTS = ["jpg", "jpeg", "png", "bmp", "webp", "heic", "tiff", "tif", "gif"]
GROUPING_EXTS = GROUPING_IMAGE_EXTS + DOC_EXTS + VIDEO_EXTS
FILING_EXTS = GROUPING_IMAGE_EXTS + DOC_EXTS

# --- limits (fixed values) ----------------------------------------------------------------------
SCAN_MIN_BYTES = 1024
HEAD_TAIL_BYTES = 16 * 1024
RELEVANT_MIN_BYTES = 30 * 1024
RELEVANT_MIN_PIXELS = 200
RADIUS_PHOTO = 2
RADIUS_SCREENSHOT = 3
FINGERPRINT_MIN_CHARS = 50
LEARN_MIN_CHARS = 20
MATCH_MIN_CHARS = 5
ENCODER_MAX_CHARS = 2000
EXEMPLARS_PER_FOLDER = 50
IMPORT_PER_FOLDER = 8
LABEL_BATCH = 20
GROUPS_PER_PAGE = 50
CLUSTERS_PER_PAGE = 30
TAG_MIN_SCORE = 0.22

# --- technical folders that hold no user content (fixed values, "/" as separator) -----------------
TECHNICAL_PATH_PARTS = [
    ".git", "node_modules", "__pycache__", "venv", ".venv",
    "appdata/local/temp", "appdata/roaming",
    "program files", "windows", "system32",
    "$recycle.bin", ".cache", "thumbnails", "thumb",
]

# --- screen sizes taken for screenshots, in either orientation (fixed values) -------------------
PHONE_SCREENS = [(1080, 1920), (1080, 2340), (1170, 2532), (1284, 2778), (1440, 2960)]
DESKTOP_SCREENS = [(1920, 1080), (2560, 1440), (2880, 1800), (3840, 2160), (3440, 1440)]

# --- display categories (fixed values) ----------------------------------------------------------
CATEGORIES = [
    "Bank", "Forex", "Conversations", "Receipts", "Tickets", "Memes", "Articles",
    "Emails", "Invoices", "CV", "Contracts", "Reports", "Spreadsheets", "Other",
]

# --- text patterns per category (fixed values; matched without regard to case) ------------------
KEYWORD_PATTERNS = {
    "Bank": [
        r"\biban\b",
        r"\brib\b",
        r"\bsolde\b",
        r"\bvirement\b",
        r"\bcompte courant\b",
        r"credit mutuel|boursorama|societe generale|bnp|caisse d.epargne|la banque postale",
    ],
    "Forex": [
        r"metatrader|tradingview",
        r"\beur/?usd\b|gbp/?jpy\b|xau/?usd\b|btc/?usd\b",
        r"\b[mh]\d{1,2}\b\s*(?:timeframe)?",
        r"\bpip(s)?\b|\bleverage\b|\btake\s*profit\b|\bstop\s*loss\b",
    ],
    "Conversations": [
        r"whatsapp|telegram|messenger|imessage|signal",
        r"\b(en ligne|online|vu a|seen at)\b",
    ],
    "Receipts": [
        r"\btva\b|\bttc\b|\bht\b",
        r"recu|ticket de caisse",
        r"\btotal\b.*\d+[.,]\d{2}",
    ],
    "Invoices": [
        r"\bfacture\b|\binvoice\b|\bbill to\b|\bfacturer a\b",
        r"\bn[°o]\s*facture\b|\binvoice\s*(no|number|#)\b",
        r"\bmontant\s+(total|du|a payer)\b",
        r"\bdate\s+d[']?[eé]ch[eé]ance\b|\bdue date\b",
    ],
    "CV": [
        r"\bcurriculum vitae\b|\bresume\b|\bcv\b",
        r"\bexp[eé]rience\s+professionnelle\b|\bwork experience\b",
        r"\bformation\b|\beducation\b|\bdiplom[eé]\b",
        r"\bcomp[eé]tences\b|\bskills\b",
    ],
    "Contracts": [
        r"\bcontrat\b|\bcontract\b|\bagreement\b|\baccord\b",
        r"\bclause\b|\bparties\b|\bsignataire\b",
        r"\bconditions g[eé]n[eé]rales\b|\bterms and conditions\b",
        r"\bdur[eé]e du contrat\b|\bterm of (the )?agreement\b",
    ],
    "Reports": [
        r"\brapport\b|\breport\b",
        r"\bsommaire\b|\btable des mati[eè]res\b|\btable of contents\b",
        r"\bconclusion\b|\bsynthese\b|\bexecutive summary\b",
    ],
}

# --- file name patterns -> category = folder (fixed values; first hit wins, case ignored) -------
FILENAME_PATTERNS = [
    (r"^screen[\s\-_]?shot", "Screenshots"),
    (r"^capture[\s\-_]", "Screenshots"),
    (r"^screenshot", "Screenshots"),
    (r"^whatsapp\s*image", "WhatsApp"),
    (r"^wa\d+\.jpe?g$", "WhatsApp"),
    (r"^snapchat[\s\-_]", "Snapchat"),
    (r"^img[_\-]\d{4}", "Photos"),
    (r"^dsc[fn]?\d{3,}", "Photos"),
    (r"^pxl[_\-]\d{8}", "Photos"),
    (r"^vlcsnap[\s\-_]", "VideoFrames"),
    (r"^facebook[\s\-_]", "Facebook"),
    (r"^insta(gram)?[\s\-_]", "Instagram"),
    (r"^meme[\s\-_]", "Memes"),
]

# --- candidate tags of the zero-shot tagger (fixed values) --------------------------------------
TAGS = [
    "photo de famille", "portrait", "groupe de personnes", "selfie",
    "paysage", "plage", "mer", "ville", "rue", "campagne", "montagne",
    "foret", "lac", "ciel", "nuit",
    "voiture", "moto", "velo", "bateau", "avion",
    "nourriture", "boisson", "plat cuisine", "dessert",
    "fleur", "plante", "arbre", "animal", "chat", "chien", "oiseau",
    "vetements", "chaussures", "bijou",
    "meuble", "chaise", "table", "lit", "canape", "lampe",
    "document", "papier officiel", "facture", "recu", "ticket",
    "contrat", "rapport", "courrier", "lettre",
    "ecran ordinateur", "code informatique", "site internet",
    "graphique", "tableau de bord", "chart de trading",
    "presentation slides",
    "conversation messagerie", "whatsapp", "telegram", "messenger",
    "email", "reseau social", "facebook", "instagram", "tiktok",
    "design graphique", "logo", "illustration", "art moderne",
    "media art", "installation lumineuse", "led",
    "meme humoristique", "capture d ecran", "scan document",
    "art ancien", "musee", "exposition",
]

# --- stop words, French then English then office words (fixed values) ---------------------------
STOPWORDS = """
le la les un une des de du au aux
et ou mais donc or car ni que qui quoi dont
pour par avec sans sur sous dans vers chez
ce cette ces cet son sa ses leur leurs
mon ma mes ton ta tes notre nos votre vos
je tu il elle on nous vous ils elles
est etre ete suis es sont etais etait fut
avoir ai as ont avait aura eu
se lui moi toi soi
pas ne non oui si tres plus moins trop
tout tous toute toutes rien aucun aucune
fait faire ferai doit doivent peut peuvent
comme alors ainsi puis ensuite encore deja
the a an and but for to of in at
by with from is are was were be been
being have has had do does did this that
these those i you he she it we they what
which who whom if then than so such not no
yes very more less too any all some each
every other new old first last only own same
page pages
tel fax email mail
""".split()
