"""Word lists and tables of the biographical domain."""

# --- Fixed values ---------------------------------------------------------------------------------

LABEL_PREFIX = {
    "Politician": "pol", "Position": "pos", "Location": "loc", "Award": "awa", "MilitaryCareer": "mil", "MilitaryRank": "mil",
    "Campaigns": "cam", "AlmaMater": "alm", "AcademicTitle": "aca",
}

#: Edge type: from, to, properties, whether an import script writes its properties.
EDGE_TYPES = {
    "SERVED_AS": ("Politician", "Position", ("term_start", "term_end", "status"), True),
    "SUCCEEDED": ("Politician", "Politician", ("position_id",), True),
    "PRECEDED": ("Politician", "Politician", ("position_id",), True),
    "BORN_AT": ("Politician", "Location", (), False),
    "DIED_AT": ("Politician", "Location", (), False),
    "AWARDED": ("Politician", "Award", (), False),
    "SERVED_IN": ("Politician", "MilitaryCareer", ("year_start", "year_end"), True),
    "HAS_RANK": ("Politician", "MilitaryRank", (), False),
    "FOUGHT_IN": ("Politician", "Campaigns", (), False),
    "ALUMNUS_OF": ("Politician", "AlmaMater", (), False),
    "HAS_ACADEMIC_TITLE": ("Politician", "AcademicTitle", (), False),
}

NODE_DENY = ["id", "name", "type", "source", "created_at", "last_updated", "enriched"]
EDGE_DENY = ["source", "created_at", "type"]

#: Patterns of wiki markup, with their flags.
MARKUP = {
    "template": r"\{\{[^}]+\}\}",
    "innermost template": r"\{\{[^{}]*\}\}",
    "reference": r"(?s:<ref[^>]*>.*?</ref>)",
    "any reference": r"(?is:<ref[^>]*>.*?</ref>)",
    "short reference": r"<ref[^>]*/?>",
    "closed reference": r"(?i:<ref[^/>]*/>)",
    "comment": r"(?s:<!--.*?-->)",
    "size": r"(?i:\b\d+(?:x\d+)?px\b\s*)",
    "layout": r"(?i:\b(?:border|thumb|link|frameless|upright|center|left|right|none)\b\s*)",
    "layout and bar": r"(?i:\b(?:border|thumb|link|frameless|upright|center|left|right|none)\b\s*\|?\s*)",
    "media": r"(?i:\[\[(?:Tập[_ ]?tin|File|Image|Hình):[^\]]+\]\])",
    "summary media": r"(?i:\[\[(?:Tập tin|File|Hình|Image):[^\]]*\]\])",
    "media link": r"(?i:\[\[[^\]]*(?:file:|image:|tập tin:|hình:)[^\]]*\]\])",
    "address": r"(?i:https?://[^\s\]]+)",
    "link": r"\[\[(?:[^\]]*\|)?\s*([^\]|]*?)\s*\]\]",
    "summary link": r"\[\[(?:[^\]|]*\|)?([^\]]+)\]\]",
    "labelled address": r"\[http[^\s\]]+\s+([^\]]+)\]",
    "bare address": r"\[http[^\]]+\]",
    "break or bullet": r"(?i:<br\s*/?\s*>)|\n\s*\*\s*|\*\s*",
    "tag": r"<[^>]+>",
}

PRIORITY_TEMPLATES = [
    "viên chức", "Viên chức", "thông tin viên chức", "Thông tin viên chức", "infobox", "infobox viên chức", "infobox nhân vật",
    "infobox officeholder", "infobox officeholder 1", "infobox officeholder1", "thông tin nhân vật", "thông tin chính khách",
    "thông tin chức vụ", "chức vụ", "Thông tin chức vụ", "Thông tin chính khách",
]
TEMPLATE_WORDS = ["infobox", "thông tin"]
TEMPLATE_NOT = ["succession", "section", "collapsed", "/", "thứ tự"]

NAME_EXCLUDED = [
    "tập tin:", "file:", "hình:", "image:", "thể loại:", "category:", "wikipedia:", "wp:", "template:", "mẫu:", "đầu tiên", "first",
    "none", "vacant", "không có", "chưa có", "mới thành lập", "position established", "office established",
]
PAGE_NAME_EXCLUDED = [
    "Việt Nam", "Đảng Cộng sản Việt Nam", "Ban Chấp hành Trung ương", "Danh sách", "Chính phủ", "Ủy ban", "Hội đồng", "Thành viên",
    "Trung ương", "TP", "TP.", "Thành phố", "Ban Bí thư", "Bộ Chính trị",
]
IGNORED_VALUES = ["chức vụ kết thúc", "đương nhiệm", "incumbent", "none", "n/a", "-", ""]

LOCAL_WORDS = [
    "việt nam", "vietnam", "viet nam", "hà nội", "sài gòn", "hanoi", "saigon", "hồ chí minh", "đà nẵng", "hải phòng", "cần thơ",
    "bắc ninh", "hải dương", "nam định", "thái bình", "nghệ an", "thanh hóa", "quảng nam", "quảng ngãi", "đồng nai", "bình dương",
    "vũng tàu", "long an", "tiền giang", "bến tre", "vĩnh long", "an giang", "kiên giang", "cà mau", "bạc liêu", "sóc trăng",
    "cộng hòa xã hội chủ nghĩa việt nam", "việt nam dân chủ cộng hòa", "việt nam cộng hòa",
    "bắc kỳ", "trung kỳ", "nam kỳ", "bắc bộ", "trung bộ", "nam bộ",
    "bà rịa - vũng tàu", "bắc giang", "bắc kạn", "bình định", "bình phước", "bình thuận", "cao bằng", "đắk lắk", "đắk nông", "điện biên",
    "đồng tháp", "gia lai", "hà giang", "hà nam", "hà tĩnh", "hậu giang", "tp. hồ chí minh", "hòa bình", "hưng yên", "khánh hòa",
    "kon tum", "lai châu", "lâm đồng", "lạng sơn", "lào cai", "ninh bình", "ninh thuận", "phú thọ", "phú yên", "quảng bình",
    "quảng ninh", "quảng trị", "sơn la", "tây ninh", "thái nguyên", "thừa thiên - huế", "trà vinh", "tuyên quang", "vĩnh phúc", "yên bái",
]
FOREIGN_WORDS = [
    "thái lan", "thailand", "bangkok", "brunei", "bandar seri begawan", "singapore", "singapo", "malaysia", "kuala lumpur",
    "indonesia", "jakarta", "philippines", "manila", "myanmar", "burma", "yangon", "cambodia", "campuchia", "phnom penh",
    "laos", "lào", "vientiane", "trung quốc", "china", "beijing", "bắc kinh", "nhật bản", "japan", "tokyo", "hàn quốc", "korea", "seoul",
    "ấn độ", "india", "new delhi", "hoa kỳ", "america", "washington", "nga", "russia", "moscow", "pháp", "france", "paris",
    "anh", "britain", "london",
]
INVALID_TEMPLATES = [
    "báo chí", "thông tin báo chí", "cơ quan", "infobox cơ quan", "tổ chức", "organization", "company", "công ty", "website", "trang web",
    "newspaper", "tờ báo", "magazine", "tạp chí", "đài", "station", "trường", "school", "university", "đại học", "bệnh viện", "hospital",
    "ngân hàng", "bank", "đảng", "party", "political party", "ban", "committee", "bộ", "ministry", "settlement", "địa điểm",
    "building", "tòa nhà", "event", "sự kiện", "thông tin nhân vật hoàng gia", "hoàng gia", "royalty",
]
VALID_TEMPLATES = [
    "officeholder", "infobox officeholder", "military person", "infobox military person", "person", "infobox person", "infobox viên chức",
    "infobox nhân vật", "nhân vật", "thông tin nhân vật", "nhà chính trị", "quân nhân", "president", "prime minister", "viên chức",
    "thông tin viên chức", "thông tin chính khách", "chính khách", "chức vụ", "thông tin chức vụ",
]

EXPELLED = ["khai trừ", "khai trư", "khai tru"]
EXPELLED_LABEL = "Đã bị khai trừ khỏi Đảng"
PARTIES = {
    "Đảng Cộng sản Việt Nam": "Đảng Cộng sản Việt Nam",
    "Đảng Cộng Sản Việt Nam": "Đảng Cộng sản Việt Nam",
    "Dang Cong san Viet Nam": "Đảng Cộng sản Việt Nam",
    "ĐCSVN": "Đảng Cộng sản Việt Nam",
    "Đảng Lao động Việt Nam": "Đảng Lao động Việt Nam",
    "Không": "Không đảng phái",
    "không": "Không đảng phái",
    "Không có": "Không đảng phái",
}
DEFAULT_PARTY = "Đảng Cộng sản Việt Nam"

DISMISSED = ["cách chức", "khai trừ", "bị xóa", "thôi chức", "truất phế", "phế truất", "tước bỏ", "sa thải", "kỷ luật cách chức", "đuổi việc"]
RELIEVED = ["miễn nhiệm", "bãi nhiệm", "bãi bỏ", "thôi việc", "từ chức", "nghỉ việc"]
DISMISSED_LABEL, RELIEVED_LABEL = "bị cách chức", "miễn nhiệm"

#: Field names of info boxes.
KEY_ALIASES = {
    "tên": "name", "name": "name", "tiền tố": "honorific_prefix", "honorific_prefix": "honorific_prefix", "hậu tố": "honorific_suffix",
    "honorific_suffix": "honorific_suffix", "hình": "image", "image": "image", "cỡ hình": "imagesize", "imagesize": "imagesize",
    "miêu tả": "caption", "caption": "caption", "alt": "alt", "chức vụ": "office", "office": "office", "nhiệm kỳ": "term", "term": "term",
    "bắt đầu": "term_start", "term_start": "term_start", "kết thúc": "term_end", "term_end": "term_end", "tiền nhiệm": "predecessor",
    "predecessor": "predecessor", "trước": "predecessor", "kế nhiệm": "successor", "successor": "successor", "sau": "successor",
    "trưởng chức vụ": "leader_title", "trưởng viên chức": "leader_name", "leader_title": "leader_title", "leader_name": "leader_name",
    "phó chức vụ": "deputy_title", "phó viên chức": "deputy_name", "phó": "deputy", "deputy": "deputy", "deputy_title": "deputy_title",
    "deputy_name": "deputy_name", "địa hạt": "constituency", "constituency": "constituency", "quê quán": "hometown", "hometown": "hometown",
    "nơi_ở": "residence", "nơi ở": "residence", "ngày sinh": "birth_date", "birth_date": "birth_date", "nơi sinh": "birth_place",
    "birth_place": "birth_place", "ngày mất": "death_date", "death_date": "death_date", "nơi mất": "death_place", "death_place": "death_place",
    "nơi an táng": "resting_place", "resting_place": "resting_place", "năm_sinh": "birth_date", "birth_year": "birth_date",
    "ngày_chết": "death_date", "nơi_chết": "death_place", "quốc tịch": "nationality", "nationality": "nationality", "dân tộc": "ethnicity",
    "ethnicity": "ethnicity", "tôn giáo": "religion", "đạo": "religion", "religion": "religion", "nghề nghiệp": "occupation",
    "occupation": "occupation", "nghề": "occupation", "đảng": "party", "party": "party", "đảng_khác": "party",
    "ngày vào đảng": "party_entry_date", "party_entry_date": "party_entry_date", "vợ": "spouse", "chồng": "spouse", "spouse": "spouse",
    "con": "children", "children": "children", "cha": "father", "father": "father", "mẹ": "mother", "mother": "mother",
    "họ hàng": "relatives", "relatives": "relatives", "học vấn": "education", "giáo dục": "education", "giáo_dục": "education",
    "education": "education", "học trường": "alma_mater", "alma_mater": "alma_mater", "trình_độ": "education", "giải thưởng": "awards",
    "khen thưởng": "awards", "awards": "awards", "danh_hiệu": "awards", "cấp bậc": "military_rank", "military_rank": "military_rank",
    "rank": "military_rank", "thuộc": "branch", "branch": "branch", "năm phục vụ": "years_of_service", "năm tại ngũ": "years_of_service",
    "years_of_service": "years_of_service", "đơn vị": "unit", "unit": "unit", "chỉ huy": "commands", "commands": "commands",
    "tham chiến": "battles", "battles": "battles", "chữ ký": "signature", "signature": "signature", "ghi chú": "footnotes",
    "footnotes": "footnotes", "website": "website", "nickname": "nickname", "biệt danh": "nickname", "embed": "embed", "module": "module",
    "cont": "cont", "titlestyle": "titlestyle", "khác": "other", "other": "other", "thêm": "other",
}

#: Place name in a text: province today. The first that matches counts.
PROVINCES = [
    ("Hà Nội", "Hà Nội"), ("Thành phố Hà Nội", "Hà Nội"), ("TP Hà Nội", "Hà Nội"), ("Hồ Chí Minh", "Hồ Chí Minh"),
    ("Thành phố Hồ Chí Minh", "Hồ Chí Minh"), ("TP Hồ Chí Minh", "Hồ Chí Minh"), ("TP HCM", "Hồ Chí Minh"), ("Sài Gòn", "Hồ Chí Minh"),
    ("Đà Nẵng", "Đà Nẵng"), ("Hải Phòng", "Hải Phòng"), ("Cần Thơ", "Cần Thơ"), ("Hà Giang", "Hà Giang"), ("Cao Bằng", "Cao Bằng"),
    ("Lào Cai", "Lào Cai"), ("Lai Châu", "Lai Châu"), ("Sơn La", "Sơn La"), ("Điện Biên", "Điện Biên"), ("Yên Bái", "Yên Bái"),
    ("Hoà Bình", "Hoà Bình"), ("Hòa Bình", "Hoà Bình"), ("Thái Nguyên", "Thái Nguyên"), ("Lạng Sơn", "Lạng Sơn"), ("Quảng Ninh", "Quảng Ninh"),
    ("Bắc Giang", "Bắc Giang"), ("Phú Thọ", "Phú Thọ"), ("Vĩnh Phúc", "Vĩnh Phúc"), ("Bắc Ninh", "Bắc Ninh"), ("Bắc Kạn", "Bắc Kạn"),
    ("Tuyên Quang", "Tuyên Quang"), ("Thái Bình", "Thái Bình"), ("Hà Nam", "Hà Nam"), ("Hưng Yên", "Hưng Yên"), ("Nam Định", "Nam Định"),
    ("Hải Dương", "Hải Dương"), ("Ninh Bình", "Ninh Bình"), ("Thanh Hóa", "Thanh Hóa"), ("Nghệ An", "Nghệ An"), ("Hà Tĩnh", "Hà Tĩnh"),
    ("Quảng Bình", "Quảng Bình"), ("Quảng Trị", "Quảng Trị"), ("Thừa Thiên Huế", "Thừa Thiên Huế"), ("Thừa Thiên", "Thừa Thiên Huế"),
    ("Quảng Nam", "Quảng Nam"), ("Quảng Ngãi", "Quảng Ngãi"), ("Bình Định", "Bình Định"), ("Phú Yên", "Phú Yên"), ("Khánh Hòa", "Khánh Hòa"),
    ("Ninh Thuận", "Ninh Thuận"), ("Bình Thuận", "Bình Thuận"), ("Kon Tum", "Kon Tum"), ("Gia Lai", "Gia Lai"), ("Đắk Lắk", "Đắk Lắk"),
    ("Đắk Nông", "Đắk Nông"), ("Lâm Đồng", "Lâm Đồng"), ("Bình Phước", "Bình Phước"), ("Tây Ninh", "Tây Ninh"), ("Bình Dương", "Bình Dương"),
    ("Đồng Nai", "Đồng Nai"), ("Bà Rịa - Vũng Tàu", "Bà Rịa - Vũng Tàu"), ("Bà Rịa – Vũng Tàu", "Bà Rịa - Vũng Tàu"),
    ("Bà Rịa", "Bà Rịa - Vũng Tàu"), ("Vũng Tàu", "Bà Rịa - Vũng Tàu"), ("Long An", "Long An"), ("Tiền Giang", "Tiền Giang"),
    ("Bến Tre", "Bến Tre"), ("Trà Vinh", "Trà Vinh"), ("Vĩnh Long", "Vĩnh Long"), ("Đồng Tháp", "Đồng Tháp"), ("An Giang", "An Giang"),
    ("Kiên Giang", "Kiên Giang"), ("Hậu Giang", "Hậu Giang"), ("Sóc Trăng", "Sóc Trăng"), ("Bạc Liêu", "Bạc Liêu"), ("Cà Mau", "Cà Mau"),
    ("Hải Hưng", "Hải Dương"), ("Hải Hung", "Hải Dương"), ("Hà Tây", "Hà Nội"), ("Hà Đông", "Hà Nội"), ("Phong Dinh", "Cần Thơ"),
    ("Minh Hải", "Cà Mau"), ("Quảng Tín", "Quảng Nam"), ("Quảng Đức", "Đắk Nông"), ("Gia Định", "Hồ Chí Minh"), ("Vĩnh Bình", "Trà Vinh"),
    ("Kiến Hòa", "Bến Tre"), ("Kiến Tường", "Long An"), ("Thuận Hải", "Bình Thuận"), ("Phú Khánh", "Khánh Hòa"), ("Song Bé", "Bình Phước"),
    ("Đồng Tháp Mười", "Đồng Tháp"),
]

#: Edge type: phrase forwards, backwards, as a question, and variants.
RELATION_PHRASES = {
    "SERVED_AS": ("đã từng giữ chức vụ", "là chức vụ được giữ bởi", "giữ chức vụ gì", ["đảm nhiệm vị trí", "làm việc với cương vị", "được bổ nhiệm làm"]),
    "SUCCEEDED": ("kế nhiệm", "được kế nhiệm bởi", "kế nhiệm ai", ["nối nghiệp", "tiếp nối", "thay thế"]),
    "PRECEDED": ("tiền nhiệm", "có tiền nhiệm là", "là tiền nhiệm của ai", ["đi trước", "có nhiệm kỳ trước"]),
    "BORN_AT": ("sinh tại", "là nơi sinh của", "sinh ở đâu", ["quê quán tại", "có quê ở", "ra đời tại"]),
    "DIED_AT": ("qua đời tại", "là nơi mất của", "mất ở đâu", ["từ trần tại", "qua đời ở"]),
    "AWARDED": ("được trao tặng", "là giải thưởng của", "nhận giải thưởng gì", ["được vinh danh", "được tặng thưởng", "nhận danh hiệu"]),
    "SERVED_IN": ("phục vụ trong", "có thành viên", "phục vụ trong đơn vị nào", ["công tác tại", "hoạt động trong"]),
    "HAS_RANK": ("có cấp bậc", "là cấp bậc của", "có cấp bậc gì", ["đạt quân hàm", "được phong hàm"]),
    "FOUGHT_IN": ("tham gia chiến dịch", "có sự tham gia của", "tham gia chiến dịch nào", ["chiến đấu trong", "tham chiến tại"]),
    "ALUMNUS_OF": ("là cựu sinh viên của", "có cựu sinh viên", "tốt nghiệp trường nào", ["học tại", "từng học ở", "đào tạo tại"]),
    "HAS_ACADEMIC_TITLE": ("có học vị", "là học vị của", "có học vị gì", ["đạt bằng", "được phong học hàm"]),
    "BORN_YEAR": ("sinh năm", "là năm sinh của", "sinh năm bao nhiêu", ["cất tiếng khóc chào đời năm", "ra đời năm"]),
    "DIED_YEAR": ("mất năm", "là năm mất của", "mất năm bao nhiêu", ["qua đời năm", "từ trần năm"]),
    "TERM_DURATION": ("có nhiệm kỳ", "là nhiệm kỳ của", "có nhiệm kỳ từ bao nhiêu đến bao nhiêu", ["giữ chức trong khoảng thời gian", "đảm nhiệm trong giai đoạn"]),
}

PATTERN_KEYWORDS = {
    "path": ["mối quan hệ", "liên quan", "kết nối", "từ.*đến", "giữa.*và", "có.*quan.*hệ", "có.*liên.*kết"],
    "chain": ["tiền nhiệm", "kế nhiệm", "trước.*sau", "thay thế", "người kế", "người trước", "sau.*ai", "trước.*ai"],
    "comparison": ["so sánh", "nhiều hơn", "ít hơn", "cao hơn", "thấp hơn", "già hơn", "trẻ hơn", "giống", "khác", "ai.*nhiều", "ai.*ít"],
    "aggregation": ["tất cả", "danh sách", "có bao nhiêu", "đếm", "tổng số", "mấy người", "những ai"],
}
INTENT_PATTERN = {"PRECEDED": "chain", "SUCCEEDED": "chain", "BORN_AT": "simple", "DIED_AT": "simple", "SERVED_AS": "simple", "ALUMNUS_OF": "simple", "AWARDED": "simple"}
PATTERN_WEIGHTS = {"keyword_match": 0.3, "entity_count": 0.2, "intent_relation": 0.3, "question_structure": 0.2}
PATTERN_ORDER = ["simple", "chain", "path", "comparison", "aggregation", "explore"]
PLANS = {
    "path": ["path"],
    "comparison": ["comparison"],
    "chain": ["intent", "explore"],
    "aggregation": ["intent"],
    "simple": ["intent", "explore", "explore"],
    "explore": ["intent", "explore", "explore"],
}

ALLOWED_ENTITY_TYPES = ["Politician", "Position", "Location", "Award", "MilitaryCareer", "MilitaryRank", "AcademicTitle", "AlmaMater", "Campaigns", "TermPeriod"]
ALLOWED_RELATION_TYPES = ["PRECEDED", "SUCCEEDED", "BORN_AT", "DIED_AT", "SERVED_AS", "ALUMNUS_OF", "HAS_RANK", "HAS_ACADEMIC_TITLE", "AWARDED", "SERVED_IN", "FOUGHT_IN"]

#: Edge type: true-false forwards and backwards, choice forwards and backwards.
EDGE_PATTERNS = {
    "BORN_AT": ("{subject} sinh ra ở {object}", "{object} là quê của {subject}", "{subject} sinh ra ở đâu?", "{object} là quê của ai?"),
    "DIED_AT": ("{subject} mất tại {object}", "{object} là nơi mất của {subject}", "{subject} mất tại đâu?", "Ai mất tại {object}?"),
    "SERVED_AS": ("{subject} từng giữ chức vụ {object}", "{object} là chức vụ mà {subject} từng giữ", "{subject} từng giữ chức vụ gì?", "Ai từng giữ chức vụ {object}?"),
    "AWARDED": ("{subject} được trao tặng {object}", "{object} được trao tặng cho {subject}", "{subject} được trao tặng giải thưởng gì?", "Ai được trao tặng {object}?"),
    "ALUMNUS_OF": ("{subject} tốt nghiệp tại {object}", "{object} là trường mà {subject} từng học", "{subject} tốt nghiệp tại trường nào?", "Ai tốt nghiệp tại {object}?"),
    "HAS_ACADEMIC_TITLE": ("{subject} có học vị {object}", "{object} là học vị của {subject}", "{subject} có học vị gì?", "Ai có học vị {object}?"),
    "FOUGHT_IN": ("{subject} tham gia trận {object}", "Trận {object} có sự tham gia của {subject}", "{subject} tham gia trận nào?", "Ai tham gia trận {object}?"),
    "SERVED_IN": ("{subject} phục vụ trong {object}", "{object} có sự phục vụ của {subject}", "{subject} phục vụ trong đơn vị quân sự nào?", "Ai phục vụ trong {object}?"),
    "HAS_RANK": ("{subject} có cấp bậc quân sự {object}", "{object} là cấp bậc quân sự của {subject}", "{subject} có cấp bậc quân sự gì?", "Ai có cấp bậc quân sự {object}?"),
    "SUCCEEDED": ("{subject} kế nhiệm {object} trong chức vụ {position}", "{object} là tiền nhiệm của {subject} trong chức vụ {position}", "{subject} kế nhiệm ai trong chức vụ {position}?", "Ai kế nhiệm {object} trong chức vụ {position}?"),
    "PRECEDED": ("{subject} là tiền nhiệm của {object} trong chức vụ {position}", "{object} kế nhiệm {subject} trong chức vụ {position}", "{subject} là tiền nhiệm của ai trong chức vụ {position}?", "Ai là tiền nhiệm của {object} trong chức vụ {position}?"),
    "BORN_YEAR": ("{subject} sinh năm {object}", "Năm {object} là năm sinh của {subject}", "{subject} sinh năm nào?", "Ai sinh năm {object}?"),
    "DIED_YEAR": ("{subject} mất năm {object}", "Năm {object} là năm mất của {subject}", "{subject} mất năm nào?", "Ai mất năm {object}?"),
    "TERM_DURATION": ("{subject} giữ chức vụ {position} {object}", "Giai đoạn {object} là thời gian {subject} giữ chức vụ {position}", "{subject} giữ chức vụ {position} trong giai đoạn nào?", "Ai giữ chức vụ {position} trong giai đoạn {object}?"),
}
#: Edge types whose patterns name a position.
NEEDS_POSITION = ["SUCCEEDED", "PRECEDED", "TERM_DURATION"]
POSITIVE_ENDINGS = [
    "Đúng hay sai?", "Đúng không?", "Đúng chưa?", "Phải không?", "Có đúng không?", "Có phải không?", "Có chính xác không?",
    "Có đúng vậy không?", "Có phải vậy không?", "Có chính xác vậy không?", "Đúng vậy không?", "Sai hay đúng?",
]
NEGATIVE_ENDINGS = [
    "Không đúng sao?", "Không phải sao?", "Không đúng à?", "Không phải à?", "Chẳng phải sao?", "Chẳng đúng sao?", "Chẳng phải à?",
    "Chẳng đúng à?", "Chẳng phải vậy sao?", "Chẳng đúng vậy sao?", "Không chính xác à?", "Không chính xác sao?", "Chẳng chính xác à?",
    "Chẳng chính xác sao?",
]
#: Types whose names stand in where a type has too few.
FALLBACK_TYPES = {
    "AcademicTitle": ["Position", "Politician"], "AlmaMater": ["Position", "Location"], "Location": ["Position", "Politician"],
    "Position": ["Politician", "Location"], "Politician": ["Position", "Location"], "Award": ["Position", "Politician"],
    "MilitaryRank": ["Position", "Politician"], "Campaigns": ["Location", "Politician"], "MilitaryCareer": ["Position", "Politician"],
}

TRUE_LABEL, FALSE_LABEL, NO_DATA_LABEL = "Đúng", "Sai", "Không có dữ kiện"
