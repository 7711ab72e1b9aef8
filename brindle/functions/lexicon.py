"""The rule tables of site, menu, catalog, entity and business-mode classification."""

from brindle.functions.rules import Rule, sub, wb

# Site mode, on folded text, whole words.
SITE = [
    Rule("rental", "text", wb("thue may anh", "cho thue", "camera rental", "rental camera", "gia thue"), 1),
    Rule("second_hand", "text", wb("may anh cu", "camera cu", "second hand", "second-hand", "used camera"), 1),
    Rule("new_camera", "text", wb("may anh chinh hang", "may anh moi", "camera moi", "new camera"), 1),
]

# Menu ranking, on folded text, anywhere. The intent is that of the first rule of MENU_INTENT that holds.
MENU = [
    Rule("SECOND_HAND", "text", sub("may anh cu", "second hand", "second-hand", "used camera"), 100),
    Rule("NEW", "text", sub("may anh chinh hang", "may anh moi", "new camera"), 100),
    Rule("RENTAL", "text", sub("thue may anh", "camera rental", "rental camera"), 100),
    Rule("camera", "text", sub("may anh", "camera"), 30),
    Rule("lens", "text", sub("ong kinh", "lens"), -100),
    Rule("accessory", "text", sub("phu kien", "accessor"), -100),
    Rule("news", "text", sub("tin tuc", "blog", "article"), -100),
    Rule("account", "text", sub("gio hang", "cart", "checkout", "login", "dang nhap"), -100),
]
MENU_INTENT = [MENU[2], MENU[1], MENU[0]]

# Roots of a rental site, on folded text and path.
ROOTS = [
    Rule("category", "place", sub("danh muc", "categories", "category"), 180),
    Rule("product", "place", sub("san pham", "products", "product"), 130),
    Rule("equipment", "place", sub("thiet bi", "equipment", "device"), 120),
    Rule("catalog", "place", sub("catalog", "shop"), 100),
    Rule("rental", "text", sub("thue", "rental"), 40),
    Rule("other", "place", sub("booking", "dat thue", "gio hang", "cart", "checkout", "policy", "chinh sach", "contact", "lien he", "blog", "tin tuc", "login", "account"), -300),
]
CONVENTIONAL_PATHS = ["/danh-muc", "/categories", "/san-pham", "/products", "/shop"]

# Entity classifier, on folded title and body.
STRONG_NEGATIVE = r"^(ong kinh|(lens|pin|sac|charger|ngam|adapter|filter|tripod|chan may|balo|tui|the nho|flash|den|softbox|gimbal|micro|may in|printer|photobooth)($|[^a-zA-Z0-9_]))"
ENTITY = [
    Rule("explicit camera type", "body", wb("mirrorless", "dslr", "may anh compact", "camera hanh trinh", "action camera"), 4),
    Rule("sensor", "body", wb("cam bien"), 2),
    Rule("ISO", "body", wb("iso"), 1),
    Rule("camera mount", "body", sub("ngam ong kinh", "e-mount", "rf-mount", "rf-s", "ef-m", "x-mount", "z-mount", "m4/3"), 2),
    Rule("viewfinder", "body", sub("kinh ngam", "evf", "viewfinder"), 1),
    Rule("camera shooting specs", "body", sub("toc do chup lien tiep", "khung hinh/giay", "fps"), 1),
    Rule("video recording specs", "body", sub("quay video.*(4k|full hd|1080p)", "4k.*fps"), 1),
    Rule("camera model family", "title", r"(^|[^a-zA-Z0-9_])((eos|alpha|powershot|coolpix|instax|lumix|gopro|insta360|osmo pocket)($|[^a-zA-Z0-9_])|zv-[a-zA-Z0-9_])", 3),
    Rule("camera body", "title", wb("body"), 2),
]
NOT_ENTITY = [
    Rule("accessory category", "body", sub("thue phu kien"), -6),
    Rule("battery specifications", "body", sub("loai pin:", "dung luong.*mah", "dien ap.*v"), -7),
    Rule("printer specifications", "body", sub("cong nghe in", "in nhiet", "giay in", "toc do in anh", "do phan giai in"), -10),
    Rule("gimbal specifications", "body", sub("gimbal chong rung", "tai trong toi da.*kg", "chong rung 3 truc"), -8),
    Rule("lighting equipment", "body", sub("cong suat.*w", "nhiet do mau", "cri", "tlci", "softbox"), -7),
    Rule("photobooth", "both", sub("photobooth"), -12),
]
CAMERA_FROM, NOT_CAMERA_TO = 5, -3

# Business mode, on lower-case text with accents, anywhere, in this order.
BUSINESS = [
    Rule("RENTAL", "body", sub("cho thuê", "giá thuê", "ngày nhận", "ngày trả", "rental"), 0),
    Rule("SECOND_HAND", "body", sub("hàng cũ", "máy ảnh cũ", "99%", "second hand", "used"), 0),
    Rule("NEW", "body", sub("chính hãng", "new 100%", "máy ảnh mới"), 0),
]

# Probe of a catalog page, on folded text.
INTENT_EVIDENCE = {
    "SECOND_HAND": sub("may anh cu", "hang cu", "99%", "second hand", "used", "chuyen mua ban may anh cu"),
    "NEW": sub("chinh hang", "may anh moi", "new 100%", "bao hanh chinh hang"),
    "RENTAL": sub("gia thue", "cho thue", "thue may anh", "ngay nhan", "ngay tra", "rental"),
}
CAMERA_EVIDENCE = sub("may anh", "camera", "canon", "sony", "nikon", "fujifilm", "lumix")
PAGE_WORDS = ["next", "last", "prev", "previous", "tiếp", "trước", "sau"]

# Catalog scan, on text with accents, any case.
NAVIGATION_TITLES = ["home", "trang chủ", "sản phẩm", "máy ảnh cũ", "máy ảnh chính hãng", "camera", "giỏ hàng", "tin tức", "liên hệ", "khuyến mãi"]
COMMERCIAL = sub("liên hệ báo giá", "best seller", "còn hàng", "hết hàng")
BRANDS = wb("canon", "sony", "nikon", "fujifilm", "fuji", "lumix", "panasonic", "olympus", "om system", "leica", "ricoh", "pentax", "gopro", "dji", "insta360")
MODELS = sub("[0-9]", "eos", "alpha", "máy ảnh", "camera", "body", "mirrorless", "dslr", "compact", "zv-", "powershot", "instax", "x-[a-z0-9]", "x[0-9]{2,4}", "d[0-9]{2,4}", "r[0-9]{1,3}")
ACCESSORY_TITLE = r"^(ống kính|(lens|pin|sạc|charger|ngàm|adapter|filter|tripod|balo|túi|flash)($|[^a-zA-Z0-9_])|thẻ nhớ[a-zA-Z0-9_])"
BAD_PATH = r"/(gio-hang|cart|checkout|login|account|tin-tuc|blog|lien-he)(/|$)"
BAD_ROOT_PATH = sub("cart", "checkout", "login", "account", "contact", "blog", "tin-tuc")

# Labels of a product page's lines, any case.
LABELS = {
    "price": ["^giá:?$", "^giá:", "^price:?$"],
    "stock": ["^tình trạng:?$", "^tình trạng:", "^trạng thái:?$", "^availability:?$"],
    "accessories": ["^phụ kiện:?$", "^phụ kiện:", "^phụ kiện đi kèm:?$"],
    "warranty": ["^bảo hành:?$", "^bảo hành:"],
    "bundle": ["^combo:?$", "^gói đi kèm:?$", "^combo/gói đi kèm:?$"],
}
SUMMARY_HEADING = r"(?iu)^tóm tắt sản phẩm\s*:?$"
SUMMARY_STOP = r"(?iu)^(địa chỉ|sđt|làm việc|hỗ trợ|thông số kỹ thuật)"
CONDITIONS = r"(?iu)cọc|thời gian thuê|ngày nhận|ngày trả|giao nhận|giao hàng|phí trễ"
