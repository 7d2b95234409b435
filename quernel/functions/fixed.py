"""They must equal those of the engine whose results these queries reproduce."""

# fmt: off

# Stop words of the index.
STOPWORDS = [
    "ve", "veya", "ile", "için", "gibi", "kadar", "daha", "çok", "az", "bir", "bu", "şu", "o", "da", "de", "ki", "mi", "mı", "mu", "mü",
    "ise", "ancak", "ama", "fakat", "yani", "göre", "olarak", "olan", "olup", "olduğu", "eden", "her", "hangi", "nedir", "kaç", "kaçtır",
    "nasıl", "ne", "neden", "nerede", "var", "yok", "the", "and", "for", "with", "of", "in", "to", "is", "are",
]

# Months and their numbers.
MONTHS = {
    "ocak": "1", "şubat": "2", "mart": "3", "nisan": "4", "mayıs": "5", "haziran": "6", "temmuz": "7", "ağustos": "8", "eylül": "9",
    "ekim": "10", "kasım": "11", "aralık": "12",
}

# Number words and their digits.
NUMBER_WORDS = {
    "bir": "1", "birinci": "1", "iki": "2", "ikinci": "2", "üç": "3", "üçüncü": "3", "dört": "4", "dördüncü": "4", "beş": "5", "beşinci": "5",
    "altı": "6", "altıncı": "6", "yedi": "7", "yedinci": "7", "sekiz": "8", "sekizinci": "8", "dokuz": "9", "dokuzuncu": "9", "on": "10",
    "onuncu": "10", "onbir": "11", "oniki": "12", "onsekiz": "18", "yirmi": "20", "yirmidört": "24", "otuz": "30", "otuziki": "32",
    "otuzaltı": "36", "kırk": "40", "kırkbeş": "45", "elli": "50", "altmış": "60", "yetmiş": "70", "seksen": "80", "doksan": "90",
    "yüz": "100", "onbinde": "0,0001", "yüzbinde": "0,00001", "binde": "0,001",
}

# Words that an answer may use whatever its sources say.
DISCOURSE_WORDS = [
    "kaynak", "kaynakta", "kaynaklarda", "kaynaklardan", "kaynağında", "kaynağından", "belgede", "belgelerde", "belgelerden", "yüklenen",
    "belirtilen", "belirtilmiş", "belirtilmiştir", "belirtilmektedir", "belirtilmemiştir", "geçmektedir", "yazmaktadır", "bulunmamaktadır",
    "bulunmaktadır", "bulunmuyor", "bulunmakta", "mevcuttur", "mevcut", "değildir", "değil", "yoktur", "dolayısıyla", "nedenle", "sebeple",
    "sonuç", "sonucunda", "özetle", "kısacası", "böylece", "ayrıca", "buna", "bunun", "şekilde", "şöyledir", "durumda", "durumunda",
    "halinde", "hâlinde", "ancak", "dolayı", "soru", "sorunun", "soruda", "sorulan", "cevap", "cevabı", "cevaben", "yanıt", "yanıtı",
    "bilgi", "bilgiler", "bilgisi", "bilgiye", "ifade", "eder", "edilir", "edilmektedir", "olarak", "olan", "olduğu", "göre", "ilgili",
    "hakkında", "yönelik", "üzere", "gerekir", "gerekmektedir", "yapılır", "yapılmaktadır", "verilir", "verilmektedir", "arasında",
    "arasındaki", "aralığında", "aralığındadır", "tarafından", "içinde", "içerisinde", "üzerinden", "boyunca", "süresince", "kapsamındaki",
    "itibaren", "doğrultusunda", "karşılığında", "olmalıdır", "olmaktadır", "olabilir", "olmuştur", "olacaktır", "edilmiştir",
    "edilmelidir", "yapılmalıdır", "sağlanmalıdır", "belirlenmiştir", "belirlenir", "uygulanır", "uygulanmaktadır", "sayılır", "sayılmaz",
    "geçerlidir", "zorunludur",
]
# fmt: on

# Lower-casing that differs from Unicode's default.
UPPER, LOWER = "IİŞĞÜÖÇ", "ıişğüöç"

# Stems, retrieval and ranking defaults.
STEM_FROM, STEM_LEN, STEM_WEIGHT = 7, 6, 0.6
K1, B = 1.5, 0.75
TOP_K, FINAL_K, RRF_K, MIN_SIMILARITY, MIN_COVERAGE, MMR_LAMBDA, PER_DOCUMENT, FALLBACK_K = 20, 4, 60, 0.35, 0.5, 0.6, 3, 60
LOW_CONFIDENCE, MIN_CHUNK, CHUNK, OVERLAP = 0.55, 80, 700, 150
Z95 = 1.959963984540054

# Patterns (Java syntax; they don't depend on how \w is read).
TOKEN = r"[0-9][0-9.,]*[0-9]|[0-9]|\p{L}+"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
CITATION = r"\[K\s*([0-9]{1,2})\]"
BARE_CITATION = r"(?U)\bK\s?[0-9]{1,2}\b"
SENTENCE_END = r"(?<=[.!?:])\s+(?=[A-ZÇĞİÖŞÜ«\"'\-•*0-9\[(])"
LIST_ITEM = r"^(?:[-*•]|[0-9]+[.)])\s+"
META = r"(?iu)bu bilgi(?:ler)?\b[^.]*\b(kayna[kğ]|belge)|kayna[kğ][a-zçğıöşü]*[ndan]* (?:elde edil|al[ıi]nm)|yukar[ıi]daki (?:kayna[kğ]|belge)|belirtilen kayna[kğ]|kaynaklarda (?:yer alan|belirtildi)"
CONNECTIVE = r"(?iu)^\s*(?:\[K\s*\d+\]\s*)*(bu nedenle|bu sebeple|dolay[ıi]s[ıi]yla|sonu[cç] olarak|[oö]zetle|bu [sş]ekilde|b[oö]ylece|buna g[oö]re|bu bilgi|bu veriler|bu de[ğg]erler|yani|k[ıi]sacas[ıi]|bu,|bu\b)"
HEADING = r"^(?:(?:MADDE|Madde)\s+[0-9]+|(?:BÖLÜM|Bölüm)\s+[0-9IVXA-ZÇĞİÖŞÜ]+|[0-9]+(?:\.[0-9]+)*\.?\s+[A-ZÇĞİÖŞÜ][^\n]{2,80})$"
#: Letters whose capital is several letters.
OWN_CAPITALS = "\u0149\u01f0\u0390\u03b0\u0587\u1e96\u1e97\u1e98\u1e99\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f88\u1f89\u1f8a\u1f8b\u1f8c\u1f8d\u1f8e\u1f8f\u1f98\u1f99\u1f9a\u1f9b\u1f9c\u1f9d\u1f9e\u1f9f\u1fa8\u1fa9\u1faa\u1fab\u1fac\u1fad\u1fae\u1faf\u1fb2\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u0390\u1fd6\u1fd7\u1fe2\u03b0\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\u1ffc\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\ufb13\ufb14\ufb15\ufb16\ufb17"
ARTICLE = r"(?m)(?=(?:^[ \t]*|(?<=[.:]\s))(?:MADDE\s+[0-9]+|Madde\s+[0-9]+|[0-9]{1,2}\.[0-9]{1,2}(?:\.[0-9]{1,2})?)[ \t]*[-–—.)]?[ \t])"
MONTH_NAMES = "Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık"
ROW_NUMBER = r"(?U)(?<![\w.,])-?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?(?![\w])|(?<![\w.,])-?[0-9]+(?:,[0-9]+)?(?![\w])"
PERIOD = rf"(?iuU)\b(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}|[0-9]{{4}}[-/.][0-9]{{1,2}}\b|\b[0-9]{{1,2}}[-/.][0-9]{{4}}|(?:{MONTH_NAMES})\s*[/-]?\s*[0-9]{{4}}|[0-9]{{4}}\s+(?:{MONTH_NAMES}))\b"
MONEY = r"(?U)[0-9],[0-9]{2}\b"
GLUED = r"(?U)\b(?=\w*[A-Za-zÇĞİÖŞÜçğıöşü])(?=\w*[0-9])\w{4,}\b"
ODD = r"[«»“”„~^_\\<>{}—–]|\.{2,}"
LONE_LETTER = r"(?U)(?<!\w)[A-Za-zÇĞİÖŞÜçğıöşü](?!\w)"
TABLE_TAG = "[TABLO SATIRI]"
SEPARATORS = ["\n\nMADDE ", "\n\nMadde ", "\n\nBÖLÜM ", "\n\nBölüm ", "\n\n", "\n", ". ", "; ", ", ", " ", ""]
OUTAGE = ["yerel llm sunucusuna ulaşılamadı", "llm isteği başarısız", "winerror 10061", "connection refused", "llm erişilemez"]

# The refusal sentence, what may stand before it, and what is tidied where it stood.
REFUSAL = "Bu konu hakkında yüklenen belgelerde bilgi bulunmamaktadır."
BEFORE_REFUSAL = r"(?iu)(?:bu nedenle[,\s]*|ancak[,\s]*|fakat[,\s]*)?"
CITATIONS_BETWEEN = r"\s*(?:\[K\s*[0-9]+\]\s*)*"
TIDY = [(r"\s+([.,;])", "$1"), (r"(?U)(?<![\w\]])[.,;]\s*", " "), ("[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]
CLAUSE_NUMBER = r"^[0-9]{1,2}\.[0-9]{1,2}$"

# Parts of a numbered source block.
BLOCK_OPEN, BLOCK_SOURCE, BLOCK_PLACE, BLOCK_SECTION, BLOCK_RULE, NO_SOURCE, NO_PLACE = "[K", "] Belge: ", " | Konum: ", " | Bölüm: ", "\n---\n", "bilinmiyor", "-"
