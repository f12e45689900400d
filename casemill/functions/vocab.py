"""Patterns, word lists and labels that decide results.

They are facts of the task, not design: their order and repetitions count, because
ties go to the first entry and repeated entries score twice.
"""

# --- fixed values: patterns. (?U) gives \d, \s, \w and \b their Unicode meaning. ---
PHONE = r"(?U)(?<!\d)(?:\+91[\-\s]?)?([6-9]\d{9})(?!\d)"
WHATSAPP_LABEL = r"(?iU)(?:whatsapp(?:\s*number)?|whats\s*app(?:\s*number)?)\s*[:\-]?\s*(?:\+91[\-\s]?)?([6-9]\d{9})"
FRAUD_CALL_LABEL = r"(?iU)(?:fraud\s*call\s*number|call(?:er)?\s*number|mobile\s*number)\s*[:\-]?\s*(?:\+91[\-\s]?)?([6-9]\d{9})"
UPI = r"(?U)\b([a-zA-Z0-9.\-_]{2,64}@[a-zA-Z]{2,64})\b"
IFSC = r"(?U)\b([A-Za-z]{4}0[A-Za-z0-9]{6})\b"
URL = r"(?iU)\b((?:https?://|www\.)[^\s<>()\"']+)"
DOMAIN = r"(?iU)^(?:https?://)?(?:www\.)?([^/\s<>()\"']+)"
IP = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
ETH_WALLET = r"(?U)\b(0x[a-fA-F0-9]{40})\b"
BECH32_WALLET = r"(?iU)\b(bc1[0-9a-z]{25,39})\b"
LEGACY_WALLET = r"(?U)\b([13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
TRANSACTION = r"(?iU)(?:transaction\s*id|txn\s*id|utr|transaction)\s*[-:]?\s*(\d{10,24})"
ACCOUNT = r"(?iU)(?:\baccount(?:\s*number)?\b|\ba\/c\b)[\s:\-#]*([0-9]{8,20})"
ACCOUNT_LABEL = r"(?iU)(?:bank\s*account\s*number|account\s*number|transfer\s*account|ac(?:count)?(?:_holder)?(?:\s*number)?|a\/c)\s*[-:]?\s*(\d{8,20})"
AMOUNT = r"(?iU)(?:₹|rs\.?|rupees?)\s*([0-9][0-9,]*(?:\.\d{1,2})?)|([0-9][0-9,]*(?:\.\d{1,2})?)\s*(?:₹|rs\.?|rupees?)"
AMOUNT_PRIORITY = (
    r"(?iU)amount\s*deducted\s*[:=-]?\s*([0-9][0-9,]*)",
    r"(?iU)amount\s*lost\s*[:=-]?\s*([0-9][0-9,]*)",
    r"(?iU)(?:₹|rs\.?|rupees?)\s*([0-9][0-9,]*)",
    r"(?iU)([0-9][0-9,]*)\s*(?:₹|rs\.?|rupees?)",
)
NUMERIC_DATE = r"(?U)\b(\d{1,2})[\/\-.](\d{1,2})[\/\-.](\d{2,4})\b"
NAMED_DATE = r"(?iU)\b(\d{1,2})\s*(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december)\s*(\d{2,4})\b"
CLOCK = r"(?iU)\b(\d{1,2}:\d{2})\s*(am|pm)?\b"

# --- fixed values: gazetteers ---
BANKS = (
    "Canara Bank", "State Bank of India", "SBI", "HDFC Bank", "HDFC", "ICICI Bank", "ICICI", "Axis Bank", "Axis",
    "Punjab National Bank", "PNB", "Bank of Baroda", "Union Bank of India", "Indian Bank", "Bank of India", "IDBI Bank",
    "Kotak Mahindra Bank", "Yes Bank", "IndusInd Bank", "Central Bank of India", "UCO Bank", "Bandhan Bank", "AU Small Finance Bank",
)
UPPER_BANKS = ("SBI", "HDFC", "ICICI", "PNB", "IDBI", "UCO")
DISTRICTS = (
    "Ajmer", "Alwar", "Banswara", "Baran", "Barmer", "Bharatpur", "Bhilwara", "Bikaner", "Bundi", "Chittorgarh", "Churu",
    "Dausa", "Dholpur", "Dungarpur", "Hanumangarh", "Jaipur", "Jaisalmer", "Jalore", "Jhalawar", "Jhunjhunu", "Jodhpur",
    "Karauli", "Kota", "Nagaur", "Pali", "Pratapgarh", "Rajsamand", "Sawai Madhopur", "Sikar", "Sirohi", "Sri Ganganagar",
    "Tonk", "Udaipur", "Agra", "Delhi", "Gurugram", "Noida", "Lucknow", "Bhopal", "Indore", "Mumbai", "Pune", "Ahmedabad",
)
QUERY_DISTRICTS = (
    "Jaipur", "Jodhpur", "Ajmer", "Udaipur", "Kota", "Bikaner", "Alwar", "Sikar", "Nagaur", "Jhunjhunu", "Churu", "Dausa",
    "Dholpur", "Bharatpur", "Sawai Madhopur", "Karauli", "Baran", "Jhalawar", "Chittorgarh", "Bhilwara", "Pratapgarh",
    "Rajsamand", "Sirohi", "Tonk", "Jaisalmer",
)
QUERY_BANKS = (
    ("canara", "Canara Bank"), ("sbi", "SBI"), ("state bank", "SBI"), ("hdfc", "HDFC"), ("axis", "Axis Bank"), ("icici", "ICICI"),
    ("kotak", "Kotak"), ("bo b", "Bank of Baroda"), ("bank of baroda", "Bank of Baroda"), ("union", "Union Bank"),
)
QUERY_CRIMES = (
    ("phishing", "Phishing"), ("fake link", "Phishing"), ("fraud", "Financial Fraud"), ("financial fraud", "Financial Fraud"),
    ("ransomware", "Ransomware"), ("hacking", "Hacking"), ("identity theft", "Identity Theft"), ("blackmail", "Harassment"),
    ("harassment", "Harassment"), ("stalking", "Cyber Stalking"),
)
SUSPICIOUS_TLDS = (".xyz", ".top", ".click", ".site", ".gq", ".tk", ".ru", ".zip", ".loan", ".work", ".live", ".win")
SUSPICIOUS_DOMAIN_WORDS = ("login", "verify", "secure", "account", "update", "bank", "support")
LONG_DOMAIN = 25
MONTHS = (
    ("jan", "01"), ("january", "01"), ("feb", "02"), ("february", "02"), ("mar", "03"), ("march", "03"), ("apr", "04"), ("april", "04"),
    ("may", "05"), ("jun", "06"), ("june", "06"), ("jul", "07"), ("july", "07"), ("aug", "08"), ("august", "08"), ("sep", "09"),
    ("sept", "09"), ("september", "09"), ("oct", "10"), ("october", "10"), ("nov", "11"), ("november", "11"), ("dec", "12"), ("december", "12"),
)

# --- fixed values: classification ---
TAXONOMY = (
    ("Fake Banking App Fraud", 8, ("download", "application", "credit card", "insurance charges", "sbi credit card")),
    ("OTP Fraud", 8, ("otp", "one time password")),
    ("UPI Fraud", 8, ("upi", "collect request", "@ok", "@ybl", "@upi")),
    ("Phishing", 6, ("phishing", "fake link", "whatsapp link", "suspicious link", "http://", "https://", "www.")),
    ("Remote Access Fraud", 8, ("anydesk", "teamviewer", "quicksupport", "remote access")),
    ("KYC Fraud", 6, ("kyc", "update kyc", "verify kyc")),
    ("Sextortion", 7, ("sextortion", "private photo", "video leak", "blackmail")),
    ("APK Scam", 6, ("apk", "install app", "unknown app")),
)
UNKNOWN_SEVERITY = 4
HEURISTIC = (
    ("Financial Fraud", 7, ("otp", "upi", "transaction", "account", "money", "rupee", "withdrawn")),
    ("Phishing", 5, ("phishing", "fake link", "link", "email")),
    ("Hacking", 5, ("hack", "hacked", "breach", "unauthorized access")),
    ("Harassment", 5, ("blackmail", "harass", "abuse", "threat")),
    ("Identity Theft", 7, ("aadhaar", "identity", "kyc", "pan card")),
    ("Ransomware", 7, ("ransom", "bitcoin", "encrypted")),
)
HEURISTIC_SUMMARY = "Complaint indicates possible cyber offense; officer should verify extracted details and proceed with legal workflow."
CRIME_TYPES = ("Unknown", "Financial Fraud", "Phishing", "Hacking", "Harassment", "Identity Theft", "Ransomware", "Social Media Crime", "Cyber Stalking", "Other")
NULL_WORDS = ("null", "none", "n/a", "na", "unknown")
DOMAINS = (
    ("cybercrime_complaint", ("transaction", "txn", "upi", "hack", "facebook", "whatsapp", "otp", "cyber", "fraud", "scam", "telegram", "website", "link", "phishing", "cryptocurrency", "crypto", "wallet", "instagram", "online fraud", "cyber cell", "deducted", "lost money", "jamtara", "apk", "extracted")),
    ("banking_fraud", ("bank", "account", "a/c", "ifsc", "passbook", "branch", "cheque", "atm", "debit", "credit", "loan", "card", "deposit", "transfer", "hdfc", "sbi", "icici", "pnb", "bob", "axis bank")),
    ("legal_complaint", ("fir", "police", "complaint", "station", "si", "inspector", "accused", "ipc", "crpc", "section", "theft", "assault", "formal", "accuse", "arrest", "court", "complaining", "than", "thana", "shriman", "sho", "prarthna", "patra", "shapath")),
    ("educational_content", ("architecture", "mauryan", "notes", "dynasty", "history", "science", "math", "chapter", "lecture", "student", "class", "study", "sanchi", "stupa", "ashoka", "emperor", "king", "civilization", "harappan", "gupta", "buddhism", "jainism")),
)
OTHER_DOMAIN = "notes_documentation"

# --- fixed values: language and dialect. Repeated words score twice. ---
DIALECTS = (
    ("marwari", ("mharo", "mhara", "tharo", "thara", "mhane", "thane", "kathe", "jaye", "hove", "kun", "koni", "chhoro", "chhori", "rupiya", "rupye", "kat gayo", "aayo", "gayo", "kar gayo", "karlo", "konya", "mharo", "mhara", "mhane")),
    ("mewari", ("mhanu", "thanu", "vuno", "kune", "nhin", "nhvya", "karvyo", "avya", "bhado", "katgyo", "vuna")),
    ("shekhawati", ("kathin", "jathin", "koini", "lugai", "laado", "baatan", "rupyaji", "katai", "karis", "karego")),
    ("braj", ("mohe", "tohe", "mero", "tero", "kahe", "kachu", "nahin", "bhayo", "gayo", "ayo", "paiso", "khato", "thagyo", "batayo", "karayo")),
    ("hinglish", ("paise", "khata", "kat", "gaya", "gaye", "account", "click", "kiya", "scam", "link", "aya", "galti", "kiya", "dhokha", "hacker", "telegram", "whatsapp", "call", "group", "bol", "raha", "tha")),
)
HINDI_ROMAN_WORDS = (
    "mera", "mere", "mujhe", "maine", "paise", "rupaye", "khata", "bank", "se", "kat", "gaye", "nikal", "gaya", "dhokha", "shikayat",
    "kripya", "karyavahi", "police", "thana", "nivedan", "mahtvapurn", "mahoday", "shriman", "jankari", "praye", "vishey",
)
ENGLISH_WORDS = (
    "the", "and", "account", "transaction", "credited", "debited", "complaint", "police", "cyber", "fraud", "message", "received",
    "mobile", "number", "bank", "application", "insurance", "deducted", "investigate", "amount", "transfer", "of", "on", "from", "in",
    "as", "was", "impact", "different", "temple", "architecture", "religion", "religions", "scenes", "history", "notes", "philosophy",
    "philosophies", "please", "help", "thank", "dear", "sir", "madam", "request", "information", "subject", "reference", "regarding",
)
REGIONAL_WORDS = (
    "mharo", "mhara", "mhane", "tharo", "thara", "thane", "kathe", "jaye", "hove", "kun", "koni", "konya", "rupiya", "rupye", "kat gayo",
    "aayo", "gayo", "kar gayo", "karlo", "chhoro", "chhori", "lugai", "laado", "baatan", "paani", "paiso", "katai", "karego", "karis",
    "bhado", "avya", "karvyo", "katgyo", "vuno", "vuna", "kune", "nhin", "nhvya", "mhanu", "thanu", "kathin", "jathin", "koini", "mohe",
    "tohe", "mero", "tero", "kahe", "kachu", "nahin", "bhayo", "khato", "thagyo", "batayo", "karayo",
)
DIALECT_WORDS = (
    ("mharo", "mera"), ("mhara", "mere"), ("mhane", "mujhe"), ("mhanu", "mera"), ("tharo", "tera"), ("thara", "tere"), ("thane", "tujhe"),
    ("thanu", "tera"), ("vuno", "uska"), ("vuna", "unka"), ("kune", "kisne"), ("kathe", "kaha"), ("kathin", "kaha"), ("jathin", "jaha"),
    ("koni", "nahi"), ("konya", "nahi"), ("koini", "nahi"), ("nhin", "nahi"), ("nhvya", "nahi hua"), ("gayo", "gaya"), ("aayo", "aaya"),
    ("kat gayo", "kat gaya"), ("katgyo", "kat gaya"), ("rupiya", "rupaye"), ("rupyaji", "rupaye"), ("chhoro", "ladka"), ("chhori", "ladki"),
    ("lugai", "aurat"), ("laado", "beti"), ("baatan", "baate"), ("katai", "kabhi"), ("kar gayo", "kar gaya"), ("karvyo", "karwaya"),
    ("avya", "aaya"), ("bhado", "kiraya"), ("dhokha", "dhokha"), ("mohe", "mujhe"), ("tohe", "tumhe"), ("mero", "mera"), ("tero", "tera"),
    ("kahe", "kyon"), ("kachu", "kuch"), ("nahin", "nahi"), ("bhayo", "hua"), ("paiso", "paise"), ("khato", "khata"), ("thagyo", "thaga"),
)
WORD_PUNCTUATION = ".,;:?!'\"()[]{}"
CACHED_PHRASES = (
    ("mera bank khata se paise kat gaya", "Money was deducted from my bank account"),
    ("mera bank account se paise nikal gaye", "Money was withdrawn from my bank account"),
    ("galti se click ho gaya", "Clicked on it by mistake"),
    ("link open kiya", "Opened the phishing link"),
    ("upi pin share kiya", "Shared the UPI PIN"),
    ("paise cut gaye", "Money was deducted"),
    ("mharo paisa kat gayo", "My money was deducted"),
    ("telegram par contact kiya", "Contacted via Telegram"),
    ("whatsapp par bol raha tha", "Was speaking on WhatsApp"),
    ("link par open kiya", "Opened the link"),
    ("mohe link bhejo aur mero bank khato se paiso kat gayo", "A link was sent to me and money was deducted from my bank account"),
    ("mujhe link bhejo aur mera bank khata se paise kat gaya", "A link was sent to me and money was deducted from my bank account"),
)
PHRASES = (
    ("mharo bank khata se paise kat gaya", "money was deducted from my bank account"),
    ("mharo bank account se paise nikal gaye", "money was withdrawn from my bank account"),
    ("mera bank khata se paise kat gaya", "money was deducted from my bank account"),
    ("mera bank account se paise nikal gaye", "money was withdrawn from my bank account"),
    ("galti se click ho gaya", "clicked on it by mistake"),
    ("link open kiya", "opened the link"),
    ("upi pin share kiya", "shared the UPI PIN"),
    ("paise cut gaye", "money was deducted"),
    ("mharo paisa kat gayo", "my money was deducted"),
    ("telegram par contact kiya", "contacted via Telegram"),
    ("whatsapp par bol raha tha", "was speaking on WhatsApp"),
    ("bank khata", "bank account"),
    ("bank account", "bank account"),
    ("paise kat gaya", "money was deducted"),
    ("paise kat gaye", "money was deducted"),
    ("paise nikal gaye", "money was withdrawn"),
    ("khata se", "from account"),
    ("account se", "from account"),
    ("kat gayo", "was deducted"),
    ("kat gaya", "was deducted"),
    ("nikal gaya", "was withdrawn"),
    ("rupiya", "rupees"),
    ("rupye", "rupees"),
    ("dhokha", "fraud"),
    ("thagi", "fraud"),
    ("galti se", "by mistake"),
    ("click kiya", "clicked"),
    ("click ho gaya", "clicked"),
    ("open kiya", "opened"),
    ("bhej diya", "sent"),
    ("transfer kiya", "transferred"),
)

# --- fixed values: quality ---
RECOVERY_WORDS = (
    "account", "transaction", "deducted", "police", "complaint", "cyber", "fraud", "transfer", "mauryan", "architecture", "buddhism",
    "sanchi", "stupa", "ashoka", "emperor", "history", "complaining", "whatapp", "telegram", "amount", "cheque", "passbook", "upi", "scam",
)
AUDIT_LABELS = (
    ("phone", "Phone Number"), ("transaction_id", "Transaction ID"), ("account_number", "Bank Account"), ("upi_id", "UPI ID"),
    ("ifsc", "IFSC Code"), ("date", "Date of Event"), ("url", "phishing_url"), ("amount", "Financial Amount"),
)
PROMPT_LABELS = (
    ("phone", "Phone Numbers"), ("transaction_id", "Transaction IDs"), ("account_number", "Bank Accounts"), ("upi_id", "UPI IDs"),
    ("ifsc", "IFSC Codes"), ("date", "Dates"), ("url", "URLs"), ("amount", "Financial Amounts"),
)
MONITORED = ("phone", "account_number", "transaction_id", "amount", "upi_id")
STRICT_KEYS = ("phone", "account_number", "transaction_id", "amount", "bank")
FOOTER = "--- Verified Ingestion Telemetry ---"
COMPLETENESS_KEYS = ("victim_name", "phone", "location", "district", "amount", "transaction_id", "account_number", "bank", "upi_id", "ifsc", "domain", "crypto_wallet", "url", "ip_address", "suspicious_domain", "suspicious_ip")
FINGERPRINT_KEYS = ("crime_type", "amount", "bank", "domain", "transaction_id", "account_number", "upi_id", "crypto_wallet", "ip_address", "district")
CONFIDENCE_KEYS = ("transaction_id", "phone", "amount", "ifsc", "bank", "district", "date", "time", "upi_id", "account_number", "url", "domain", "crypto_wallet", "ip_address")
CONTEXT_KEYS = ("phone", "amount", "transaction_id", "account_number", "upi_id", "ifsc", "url", "date", "time")
EVALUATED_KEYS = ("phone", "account_number", "bank", "amount", "transaction_id", "upi_id", "ifsc")
DOCUMENT_SUFFIXES = ("jpg", "jpeg", "png", "pdf", "webp", "bmp", "tif", "tiff")
MOST_DOCUMENT_BYTES = 10 * 1024 * 1024
