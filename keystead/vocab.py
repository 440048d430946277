"""Word lists, tables and thresholds the results depend on.

Everything in this module is a fixed value of the domain, stated as plain text
in its natural order.  Nothing here is logic.
"""

from __future__ import annotations

# --- fixed values: digits and dashes -----------------------------------------
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
FULLWIDTH_ALNUM = (
    "０１２３４５６７８９"
    "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
    "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
)
ASCII_ALNUM = (
    "0123456789"
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "abcdefghijklmnopqrstuvwxyz"
)
DASHES = "－ー‐—―〜~−"
KANJI_DIGITS = "一二三四五六七八九"

# --- fixed values: eras, first year minus one ---------------------------------
ERA_BASE = {"昭和": 1925, "平成": 1988, "令和": 2018}

# --- fixed values: structure classes ------------------------------------------
# replacement cost (10,000 yen per square metre) and service life (years)
COST_UNIT = {"RC": 25.0, "SRC": 25.0, "S": 20.0, "W": 15.0, "LS": 15.0, "default": 18.0}
COST_LIFE = {"RC": 47, "SRC": 47, "S": 34, "W": 22, "LS": 34, "default": 30}
# the same two for the investment simulation
ASSET_UNIT = {"RC": 20.0, "SRC": 20.0, "S": 15.0, "W": 12.0}
ASSET_LIFE = {"RC": 47, "SRC": 47, "S": 34, "W": 22}

# --- fixed values: investment simulation --------------------------------------
DOWN_PAYMENT_RATIO = 0.10
LOAN_RATE = 0.025
OPEX_RATIO = 0.20
DEFAULT_YIELD = 0.08
GROUND_RENT_RATIO = 0.010
LOAN_YEARS_MIN, LOAN_YEARS_MAX = 20, 35
DEFAULT_LAND_PRICE = 100000

# --- fixed values: valuation defaults -----------------------------------------
MUNI_DEFAULTS = {
    "pop_growth": 0.0,
    "income": 3000,
    "total_population": 100000,
    "income_growth": 0.0,
    "density": 4000.0,
}
PASSENGER_DEFAULT = 10000
LAND_PRICE_DEFAULT = 350000
ROSENKA_RATIO, FIXED_ASSET_RATIO = 0.8, 0.7
MARKET_UNIT_DEFAULT = 30.0
YOUSEKI_DEFAULT, KENPEI_DEFAULT = 200.0, 60.0
ZONE_KEYWORDS = [
    "第一種低層", "第二種低層", "第一種中高層", "第二種中高層",
    "第一種住居", "第二種住居", "準住居", "田園住居",
    "近隣商業", "商業", "準工業", "工業", "工業専用",
]
CORNER_WORDS = ["角地", "準角地", "三方", "四方"]
TWO_SIDE_WORDS = ["二方", "両面道路"]
BUSINESS_ZONE_WORDS = ["商業", "近隣商業", "工業", "準工業", "工業専用"]
FLAG_LOT_WORDS = ["旗竿", "路地状", "敷地延長", "敷延"]
IRREGULAR_WORDS = ["不整形", "変形地", "台形地", "袋地"]
ROAD_STRUCTURES = ["角地", "二方", "三方", "四方", "敷延", "袋小路", "中間地", "両面道路"]
DIRECTIONS = ["北東", "北西", "南東", "南西", "北", "南", "東", "西"]
SETBACK_PATTERNS = [
    r"(?:セットバック|後退)(?:面積)?(?:約)?\s*([0-9\.]+)\s*(?:㎡|平米|m2|ｍ２)",
    r"([0-9\.]+)\s*(?:㎡|平米|m2|ｍ２)\s*(?:のセットバック|の後退|セットバック要)",
]

# --- fixed values: land use words ----------------------------------------------
RESIDENTIAL_WORDS = ["住宅"]
COMMERCIAL_WORDS = ["商業", "店舗", "事務所"]
UNIT_PRICE_MIN, UNIT_PRICE_MAX = 10000, 10000000
PREF_CODES = {"11": "埼玉県", "12": "千葉県", "13": "東京都", "14": "神奈川県", "23": "愛知県"}

# --- fixed values: source codes -------------------------------------------------
COMPANY_CODES = [
    "mitsui", "sumifu", "tokyu", "nomura", "misawa", "smtrc", "sumai1", "mizuho",
    "odakyu", "afr", "sekisui", "daiwa", "totate", "athome", "homes", "seibu",
    "keikyu", "sotetsu", "keisei", "daikyo", "rearie", "heim", "sumirin", "keio",
]

# --- fixed values: city names that imply a prefecture ----------------------------
CITY_PREFECTURE = {
    "神奈川県": [
        "横浜市", "川崎市", "相模原市", "横須賀市", "平塚市", "鎌倉市", "藤沢市", "小田原市",
        "茅ヶ崎市", "逗子市", "三浦市", "秦野市", "厚木市", "大和市", "伊勢原市", "海老名市",
        "座間市", "南足柄市", "綾瀬市", "三浦郡", "高座郡", "中郡", "足柄上郡", "足柄下郡", "愛甲郡",
    ],
    "千葉県": [
        "千葉市", "銚子市", "市川市", "船橋市", "館山市", "木更津市", "松戸市", "野田市",
        "茂原市", "成田市", "佐倉市", "東金市", "旭市", "習志野市", "柏市", "勝浦市",
        "市原市", "流山市", "八千代市", "我孫子市", "鴨川市", "鎌ケ谷市", "君津市", "富津市",
        "浦安市", "四街道市", "袖ケ浦市", "八街市", "印西市", "白井市", "富里市", "南房総市",
        "匝瑳市", "香取市", "山武市", "いすみ市", "大網白里市", "印旛郡", "香取郡", "山武郡",
        "長生郡", "夷隅郡", "安房郡",
    ],
    "埼玉県": [
        "さいたま市", "川越市", "熊谷市", "川口市", "行田市", "秩父市", "所沢市", "飯能市",
        "加須市", "本庄市", "東松山市", "春日部市", "狭山市", "羽生市", "鴻巣市", "深谷市",
        "上尾市", "草加市", "越谷市", "蕨市", "戸田市", "入間市", "朝霞市", "志木市",
        "和光市", "新座市", "桶川市", "久喜市", "北本市", "八潮市", "富士見市", "三郷市",
        "蓮田市", "坂戸市", "幸手市", "鶴ヶ島市", "日高市", "吉川市", "ふじみ野市", "白岡市",
        "北足立郡", "入間郡", "比企郡", "秩父郡", "児玉郡", "大里郡", "南埼玉郡", "北葛飾郡",
    ],
}
DEFAULT_PREFECTURE = "東京都"

# --- fixed values: page texts -----------------------------------------------------
NAME_LABELS = ["物件名", "名称", "マンション名", "建物名", "アパート名"]
BREADCRUMB_STOP = ["TOP", "ホーム", "詳細", "物件詳細", "物件概要", "不動産購入"]
SEO_PHRASES = ["不動産購入、", "の中古マンション", "マンション（居住用）", "の物件情報", "の中古一戸建て"]
ENDED_TITLE_WORDS = ["掲載終了", "エラー", "404", "見つかりません"]
ENDED_PHRASES = [
    "掲載が終了したか、成約済みになった可能性があります",
    "お探しの物件は、掲載が終了",
    "掲載を終了いたしました",
    "掲載終了物件",
    "ご指定の物件は掲載を終了",
    "お探しのページは見つかりませんでした",
    "お探しの物件は見つかりません",
    "お探しのページは存在しないか、掲載が終了",
]
SKIP_TITLE_WORDS = {"ended": "掲載終了物件", "busy": "サーバーが混み合っています"}
INVEST_TYPE_LABELS = ["物件種別", "物件種目", "種別", "種目"]
INVEST_APARTMENT_WORDS = ["アパート", "マンション", "ビル"]

# --- fixed values: image labels -----------------------------------------------------
IMAGE_REJECT = [
    "周辺", "環境", "駅", "学校", "店舗", "スーパー", "地図", "街なみ",
    "街並み", "コンビニ", "ドラッグストア", "小学校", "中学校", "病院",
    "公園", "役所", "郵便局", "銀行", "バス停", "道路", "現地案内図",
    "案内図", "logo", "map", "banner", "dummy", "noimage", "担当者",
    "ロゴ", "案内", "案内板", "看板", "ライフインフォメーション",
]
IMAGE_LAYOUT = ["間取", "平面", "区画"]
IMAGE_EXTERIOR = ["外観", "建物", "エントランス", "共有", "ロビー", "アプローチ", "庭"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp"]
IMAGES_PER_CATEGORY = 2
DAILY_IMAGE_BUDGET = 200

# --- fixed values: labels of one embedded JSON state ---------------------------------
STATE_SYNONYMS = {
    "価格": ["価格", "販売価格"],
    "所在地": ["所在地", "住所"],
    "交通": ["交通", "最寄り駅", "最寄駅"],
    "年間予定賃料収入": ["年間予定賃料収入", "満室時想定年収", "満室想定年収", "想定年収", "年間想定賃料"],
    "予定利回り": ["予定利回り", "表面利回り", "利回り", "想定利回り", "実質利回り"],
    "土地面積": ["土地面積", "敷地面積"],
    "建物面積": ["建物面積", "延床面積", "専有面積"],
    "間取り": ["間取り"],
    "総戸数": ["総戸数", "戸数"],
    "築年月": ["築年月", "築年"],
    "建ぺい率": ["建ぺい率", "建ペイ率"],
    "容積率": ["容積率"],
    "用途地域等": ["用途地域等", "用途地域"],
    "接道状況": ["接道状況", "接道"],
    "接道方向／幅員": ["接道方向／幅員", "接道状況", "前面道路"],
    "地目": ["地目"],
    "現況": ["現況", "建物現況"],
    "引渡可能年月": ["引渡可能年月", "引渡時期", "引渡", "引渡可能時期"],
    "取引態様": ["取引態様"],
    "備考": ["備考"],
    "土地権利": ["土地権利", "権利"],
    "管理形態": ["管理形態"],
}

# --- fixed values: screening ------------------------------------------------------------
T_SCORE_ALERT = 73.3
SCORE_MEAN_DEFAULT, SCORE_SD_DEFAULT = 55.0, 12.0
RECOMMEND_SCORE = 60.0
DISCOUNT_MIN, DISCOUNT_MAX = 15.0, 40.0
APARTMENT_CODES = ["investapartment", "investmentapartment", "apartment", "investment"]
TYPE_LABELS = {
    "mansion": "中古マンション",
    "kodate": "中古戸建",
    "tochi": "土地",
    "invest_kodate": "戸建（投資用）",
    "invest_apartment": "一棟アパート",
    "apartment": "一棟アパート",
    "investmentkodate": "戸建（投資用）",
    "investmentapartment": "一棟アパート",
    "investment": "投資用物件",
}
ERROR_ALERT_THRESHOLD = 5

# --- fixed values: duplicate score, in hundredths ------------------------------------------
DUP_BUILDING_TYPES = ["mansion", "investmentapartment", "tochi"]
DUP_LINK_AT = 85
DUP_ADDRESS_EQUAL, DUP_ADDRESS_STEPS = 50, [(0.85, 35), (0.70, 20)]
DUP_AREA_STEPS = [(0.01, 30), (0.03, 20), (0.07, 10)]
DUP_PRICE_STEPS = [(0.01, 20), (0.03, 15), (0.07, 10), (0.15, 5)]
DUP_BUILT_EQUAL = 10

# --- fixed values: image analysis reply ------------------------------------------------------
ANALYSIS_DEFAULTS = {
    "interior_score": 3.5,
    "layout_score": 3.5,
    "plot_shape_type": "unknown",
    "plot_shape_description": "",
    "maintenance_score": 3.5,
    "maintenance_comment": "",
}
NO_IMAGE_COMMENT = "画像なしのため判定不能"

# --- fixed values: training --------------------------------------------------------------------
IQR_FACTOR = 2.5
FOREST_CONTAMINATION = 0.02
ENSEMBLE_WEIGHTS = {
    "mansion": {"lgb": 0.35, "xgb": 0.35, "cat": 0.15, "rf": 0.15},
    "kodate": {"lgb": 0.35, "xgb": 0.45, "cat": 0.1, "rf": 0.1},
    "apartment": {"lgb": 0.35, "xgb": 0.45, "cat": 0.1, "rf": 0.1},
    "tochi": {"lgb": 0.3, "xgb": 0.25, "cat": 0.25, "rf": 0.2},
}
