"""Lists and codes that have to be exactly these for results to agree."""

# Speakers whose turns are procedure, matched as lower-case prefixes.
PROCEDURAL_SPEAKERS = (
    "the clerk", "the speaker", "the president", "the presiding officer",
    "the acting chair", "the chair", "the acting president",
)

# A document title names a bill when it holds one of these.
BILL_TERMS = (" ACT", " RESOLUTION")

# Forms of address, all rewritten to ADDRESS, one after the other in this order.
ADDRESS = "Mr. Speaker"
ADDRESS_FORMS = (
    "Mr. President", "Mr. Clerk", "Mr. Chair", "Mr. Chairman", "Mr. Speakerman",
    "Madam President", "Madam Speaker", "Madam Clerk", "Madam Chair",
    "Madam Chairman", "Madam Chairwoman",
)

# Title prefixes cut together with all up to the first comma.
COMMA_PREFIXES = (
    "providing for consideration of", "providing for further consideration of", "report on",
    "motion to", "concerns about", "conference report on", "request to consider",
)
# A title with this beginning names no bill.
TITLE_REJECT = "authorizing the clerk"
# Title prefixes cut by themselves, each tried once, in this order.
PLAIN_PREFIXES = (
    "supporting the ", "introduction of the ", "reintroduction of the ",
    "re-introduction of the ", "introduction of ", "reintroduction of ", "cosponsorship of ",
)
# Title endings, each tried once, in this order.
TITLE_ENDINGS = (
    " (executive session)", " (executive calendar)",
    "; and for other purposes", ", and for other purposes",
)

# Speaker spellings put right: (as found, as kept).
CHUNK_SPEAKER_ALIASES = (
    ("CAROLYN B", "CAROLYN B. MALONEY"),
    ("Ms. LOIS FRANKEL of Florida", "Ms. FRANKEL of Florida"),
    ("Ms. JACKSON LEE", "Ms. JACKSON LEE"),
    ("Ms. BORDEAUX", "Ms. BOURDEAUX"),
    ("Mr. SABAN", "Mr. SABLAN"),
    ("Ms. JOHNSON  of Texas", "Ms. JOHNSON of Texas"),
    ("Mr. SEMPOLINKSI", "Mr. SEMPOLINSKI"),
    ("Miss GONZALEZ-COLON", "Ms. GONZALEZ-COLON"),
    ("Miss RICE of New York", "Ms. RICE of New York"),
)
DOCUMENT_SPEAKER_ALIASES = (
    ("Mr. ESHOO", "Ms. ESHOO"),
    ("Mrs. CAROLYN B. MALONEY of New York", "Ms. CAROLYN B. Maloney of New York"),
    ("Mrs. CAROLYN B.", "Ms. CAROLYN B. MALONEY of New York"),
    ("Ms. JACKSON LEE", "Ms. JACKSON LEE"),
    ("Ms. BORDEAUX", "Ms. BOURDEAUX"),
    ("Mr. SWALWELL of California", "Mr. SWALWELL"),
    ("Mr. SABAN", "Mr. SABLAN"),
    ("Ms. JOHNSON  of Texas", "Ms. Johnson of Texas"),
)
DROPPED_SPEAKER = "The VICE PRESIDENT"

# Speakers whose external record is named outright: (speaker, chamber, party, full name).
SCORE_OVERRIDES = (
    ("Mrs. RODGERS of Washington", "H", "R", "McMORRIS RODGERS, Cathy"),
    ("Mr. RODNEY DAVIS of Illinois", "H", "R", "DAVIS, Rodney"),
    ("Ms. VELAZQUEZ", "H", "D", "VELÁZQUEZ, Nydia M."),
    ("Mr. DANNY K. DAVIS of Illinois", "H", "D", "DAVIS, Danny K."),
    ("Mrs. CAROLYN B. MALONEY of New York", "H", "D", "MALONEY, Carolyn Bosher"),
    ("Mr. RYAN", "H", "D", "RYAN, Timothy J."),
)
# Speakers whose roster party is named outright: (speaker, chamber or any, chamber, party).
ROSTER_OVERRIDES = (("Mr. RYAN", None, "H", "D"),)

CHAMBER_NAMES = {"Senate": "S", "House of Representatives": "H"}
SCORE_CHAMBERS = {"House": "H", "Senate": "S"}
PARTY_NAMES = {"Democratic": "D", "Republican": "R", "Independent": "I"}
PARTY_CODES = {100: "D", 200: "R", 328: "I"}
STANCES = ("against", "favor", "neutral")
STANCES_UPPER = ("AGAINST", "FAVOR", "NONE")
MISC = "Misc."
EPOCH = "1900-01-01"
CONGRESS = 117

MIN_SPEECH_CHARS = 250
MAX_CHUNK_TOKENS = 384
OVERLAP_TOKENS = 50
MAX_INPUT_TOKENS = 512

# HTML character references resolved when text is taken out of markup; "&amp;" comes last.
