"""Literal dimensions of the reports.

Each dimension is a handful of fixed rows. They are never joined: codes are
decoded with ``when`` chains or map literals, and dimensions that must show
rows without data (cashiers, the class catalogue) enter the aggregate as
marker rows. So no join depends on a dimension's size.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. These must equal the values the reports print, so they are
# kept verbatim and together here.
# ---------------------------------------------------------------------------

# Region: accepted codes (after upper/trim), mixed-case name, upper-case
# name, ordinal.
REGIONS = [
    (("VT", "VNGTAU"), "Vũng Tàu", "VŨNG TÀU", 1),
    (("BR", "BRIA"), "Bà Rịa", "BÀ RỊA", 2),
    (("LD", "LDIEN"), "Long Điền", "LONG ĐIỀN", 3),
    (("XM", "XMOC"), "Xuyên Mộc", "XUYÊN MỘC", 4),
    (("CD", "CDUC"), "Châu Đức", "CHÂU ĐỨC", 5),
]
REGION_OTHER_NAME = "Khu vực khác"
REGION_OTHER_ORDINAL = 6
REGION_OTHER_UPPER_PREFIX = "KHU VỰC KHÁC ("
REGION_OTHER_UPPER_SUFFIX = ")"
REGION_TOTAL_NAME = "⭐ TỔNG CỘNG ⭐"
REGION_TOTAL_ORDINAL = 7
YTD_TOTAL_CODE = "TOTAL"
YTD_TOTAL_LABEL = "================ TỔNG CỘNG ================"

# Usage purpose: code, name, ordinal.
PURPOSES = [
    ("H", "SINH HOẠT", 1),
    ("K", "KINH DOANH", 2),
    ("Q", "CƠ QUAN", 3),
    ("S", "SẢN XUẤT", 4),
]
PURPOSE_OTHER_NAME = "KHÁC"
PURPOSE_OTHER_ORDINAL = 99
PURPOSE_TOTAL_NAME = "TỔNG CỘNG"
PURPOSE_TOTAL_ORDINAL = 999

# Special customer class: code, name.
CLASSES = [
    ("1", "Bình thường"),
    ("CC", "chung cư"),
    ("CHU", "Chung cư cũ/Chưa phân loại"),
    ("CQ", "Cơ quan chính quyền"),
    ("D", "Sản xuất nước đá"),
    ("DNG", "Đỗ nước ghe"),
    ("G", "Khách hàng làm giá đỗ"),
    ("GD", "Cơ sở giáo dục"),
    ("H", "Chế biến hải sản"),
    ("K", "Nước tinh khiết & KT phụ gia đình"),
    ("L", "Phục vụ du lịch"),
    ("NCT", "Nhà cho thuê"),
    ("NT", "Nước nông thôn"),
    ("P", "Dầu khí"),
    ("Q", "Loại khác"),
    ("TG", "Cơ sở tôn giáo"),
    ("TOM", "Nuôi hải sản"),
    ("TR", "Trồng rau"),
    ("U", "Kinh doanh ăn uống"),
    ("VIP", "Khách hàng đặc biệt"),
    ("VT", "Lực lực vũ trang"),
    ("YT", "Y tế"),
    ("XD", "Nhóm xây dựng"),
]
CLASS_OTHER_NAME = "Mô tả khác"
CLASS_UNCLASSIFIED = "CHƯA PHÂN LOẠI"
CLASS_TOTAL_NAME = "TỔNG CỘNG"
DEFAULT_READING_CLASS = "1"

# Large-customer class catalogue: ordinal, purpose, customer group, class.
CLASS_CATALOGUE = [
    (1, "SINH HOẠT", "SINH HOẠT ĐÔ THỊ & NÔNG THÔ", "1"),
    (2, "CƠ QUAN", "CƠ QUAN CHÍNH QUYỀN", "CQ"),
    (3, "CƠ QUAN", "LỰC LƯỢNG VŨ TRANG (CÔNG AN, QUÂN ĐỘI)", "VT"),
    (4, "CƠ QUAN", "Y TẾ (CƠ SỞ KHÁM CHỮA BỆNH)", "YT"),
    (5, "CƠ QUAN", "TRƯỜNG HỌC (CƠ SỞ GIÁO DỤC)", "GD"),
    (6, "SẢN XUẤT", "NHÓM CÁC CÔNG TY KHÍ", "P"),
    (7, "SẢN XUẤT", "NHÓM XÂY DỰNG", "XD"),
    (8, "SẢN XUẤT", "NHÓM CHẾ BIẾN HẢI SẢN", "H"),
    (9, "KINH DOANH", "KINH DOANH NHÀ HÀNG - ĂN UỐNG", "U"),
    (10, "KINH DOANH", "PHỤC VỤ DU LỊCH", "L"),
]
CATALOGUE_TOTAL_ORDINAL = 999
CATALOGUE_TOTAL_LABEL = "TỔNG CỘNG SO SÁNH TĂNG GIẢM"

# Cashiers: code, display name, ordinal; the total row last.
CASHIERS = [
    ("BAOCQ", "BẢO", 1),
    ("BAYHV", "BẢY", 2),
    ("HANTN", "HÀ", 3),
    ("HIENLTT", "HIỀN", 4),
    ("THAOLN", "THẢO", 5),
    ("YENDT", "YẾN", 6),
]
CASHIER_TOTAL = ("TỔNG", "TỔNG TỒN", 99)
# Payment channel meaning bank transfer; every other value (null too) is cash.
TRANSFER_CHANNEL = "AB"

# Section labels and row-status labels of the sectioned month report.
TOP_HEADER_PREFIX = "=== TOP 10 KHÁCH HÀNG TIÊU THỤ LỚN NHẤT KHU VỰC: "
TOP_HEADER_SUFFIX = " ==="
TOP_LABEL_PREFIX = "   [Top "
TOP_LABEL_MIDDLE = "] - "
TOP_LABEL_SEPARATOR = " - "
TOP_N = 10
TOTAL_MARKER = "TỔNG CỘNG"
STATUS_SECTION = "⚙️ PHÂN TÍCH CHUYÊN SÂU"
STATUS_TOTAL_UP = "🔥 PHÁT TRIỂN MẠNH"
STATUS_UP = "📈 Tăng trưởng tốt"
STATUS_DOWN = "📉 Sụt giảm sản lượng"
STATUS_STABLE = "➖ Ổn định"
KPI_UP = "🔥 PHÁT TRIỂN MẠNH MẼ"
KPI_DOWN = "📉 SẢN LƯỢNG SỤT GIẢM"
KPI_STABLE = "➖ SẢN LƯỢNG ỔN ĐỊNH"

# Growth cell printed for exactly zero growth in the sectioned report.
ZERO_GROWTH_TEXT = "0,00 %"

# Arrears column headings: cut-off day (dd/MM) followed by these suffixes.
ARREARS_TRANSFER_SUFFIX = "_Tồn CK"
ARREARS_CASH_SUFFIX = "_Tồn TM"
ARREARS_TOTAL_SUFFIX = "_Tồn TM+CK"
ARREARS_DIFF_HEADING = "Chênh lệch tổng tồn"

# Column headings of the printed purpose and cumulative arrears reports.
PURPOSE_HEADINGS = {"purpose_code": "MÃ NHÓM", "purpose_name": "NHÓM ĐƠN VỊ SỬ DỤNG", "diff_text": "TĂNG, GIẢM", "growth_text": "%"}
CUMULATIVE_HEADINGS = {
    "cashier_name": "TÊN",
    "open_transfer": "TỒN CK LŨY KẾ",
    "open_cash": "TỒN TM LŨY KẾ",
    "open_total": "TỔNG THEO NV",
}

# Trip log.
TRIP_ORIGIN = "Vũng Tàu"
ROUTE_ARROW = " → "
TRIP_ON_ROAD = "ĐANG ĐI"
TRIP_DONE = "XONG"
DISTANCE_UNIT = " Km"
DISTANCE_MISSING = "---"

# Pipe flushing: roughness per pipe material, pig resistance per pig type.
PIPE_MATERIALS = [
    ("HDPE_PVC", "Ống nhựa cao cấp (HDPE / PVC mới)", 0.010),
    ("DUCTILE_LINED", "Ống gang dẻo có lót xi măng", 0.012),
    ("STEEL_NEW", "Ống thép công nghiệp mới", 0.013),
    ("IRON_OLD", "Ống sắt/gang cũ bám cặn", 0.015),
]
PIG_TYPES = [
    ("SOFT", "Quả mút mềm thông thường", 0.15),
    ("DENSE", "Quả mút mật độ cao / Khít chặt", 0.25),
]
GRAVITY = 9.81
BEND_90_LOSS = 0.9
BEND_45_LOSS = 0.4
VELOCITY_CAP = 15.0
METRES_PER_BAR = 10.0
TERRAIN_FLAT = "FLAT"
# Units of the flushing calculator's result panel.
FLUSH_UNITS = {
    "dz": " m",
    "net_head": " mH₂O",
    "local_loss_m": " m",
    "velocity": " m/s",
    "flow_lps": " lít/giây",
    "duration_min": " phút",
    "volume_m3": " m³",
}
