"""Fixed values of the product-catalog format: columns, aliases, rule catalogue."""

from __future__ import annotations

# The known columns of the catalog format, in file order.
KNOWN_COLUMNS = [
    "Handle", "Title", "Body (HTML)", "Vendor", "Product Category", "Type", "Tags", "Published",
    "Option1 Name", "Option1 Value", "Option2 Name", "Option2 Value", "Option3 Name", "Option3 Value",
    "Variant SKU", "Variant Grams", "Variant Inventory Tracker", "Variant Inventory Qty",
    "Variant Inventory Policy", "Variant Fulfillment Service", "Variant Price",
    "Variant Compare At Price", "Variant Requires Shipping", "Variant Taxable", "Variant Barcode",
    "Image Src", "Image Position", "Image Alt Text", "Gift Card", "SEO Title", "SEO Description",
    "Google Shopping / Google Product Category", "Google Shopping / Gender",
    "Google Shopping / Age Group", "Google Shopping / MPN", "Google Shopping / AdWords Grouping",
    "Google Shopping / AdWords Labels", "Google Shopping / Condition", "Google Shopping / Custom Product",
    "Google Shopping / Custom Label 0", "Google Shopping / Custom Label 1",
    "Google Shopping / Custom Label 2", "Google Shopping / Custom Label 3",
    "Google Shopping / Custom Label 4", "Variant Image", "Variant Weight Unit", "Variant Tax Code",
    "Cost per item", "Status",
]
REQUIRED_NEW = ["Handle", "Title"]
SENSITIVE = [
    "Variant Price", "Variant Compare At Price", "Variant Inventory Qty", "Vendor", "Type", "Tags",
    "Body (HTML)", "Published", "Status", "Product Category",
]
PRODUCT_LEVEL = ["Vendor", "Type", "Tags", "Body (HTML)", "Published", "Status", "Product Category", "Title"]
WHITESPACE_COLUMNS = [
    "Handle", "Title", "Vendor", "Type", "Product Category", "Tags", "Variant SKU", "Variant Barcode",
    "SEO Title", "SEO Description", "Status",
]
BOOLEAN_COLUMNS = ["Published", "Variant Requires Shipping", "Variant Taxable", "Gift Card"]
OPTION_COLUMNS = [
    "Option1 Name", "Option1 Value", "Option2 Name", "Option2 Value", "Option3 Name", "Option3 Value",
]
PRICE_COLUMNS = ["Variant Price", "Variant Compare At Price"]
CURRENCY_COLUMNS = ["Variant Price", "Variant Compare At Price", "Cost per item"]
IMAGE_ROW_EXTRA = [
    "Title", "Body (HTML)", "Vendor", "Type", "Tags", "Published", "Option1 Name", "Option1 Value",
    "Variant SKU", "Variant Price", "Variant Compare At Price", "Variant Inventory Qty", "Status",
]
IMAGE_ROW_CLEAR = [
    "Title", "Body (HTML)", "Vendor", "Type", "Tags", "Published", "Option1 Name", "Option1 Value",
    "Option2 Name", "Option2 Value", "Option3 Name", "Option3 Value", "Variant SKU", "Variant Price",
    "Variant Compare At Price", "Variant Inventory Qty", "Status",
]
# Columns that tell an export of an existing shop from a list of new products.
EXPORT_SIGNALS = [
    "status", "published", "image position", "variant inventory tracker",
    "variant fulfillment service", "seo title", "cost per item",
]
EXEMPT_HEADER_RE = r"^Metafield:|^mf_|^Google Shopping|^Cost per item|^Variant Inventory"
STATUS_VALUES = ["active", "draft", "archived"]
HANDLE_RE = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
SMART_CHARS_RE = r"[\x{2018}-\x{201F}\x{2039}\x{203A}\x{AB}\x{BB}\x{2013}\x{2014}\x{2026}]"
BLANK_REMOVAL_RATIO = 0.3
SIZE_WARN_BYTES = 12 * 1024 * 1024
SIZE_LIMIT_BYTES = 15 * 1024 * 1024
SPLIT_TARGET_BYTES = 14 * 1024 * 1024

# Header spellings (lower case) per catalog column.
ALIASES = {
    "Handle": ["handle", "url handle", "slug", "url slug", "url"],
    "Title": ["item name", "product name", "product title", "name", "item title"],
    "Body (HTML)": [
        "body", "body html", "description html", "html description", "long description", "product description",
    ],
    "Vendor": ["vendor", "brand", "manufacturer", "supplier", "brand name"],
    "Type": ["type", "product type"],
    "Product Category": ["category", "product category"],
    "Tags": ["tags", "keywords", "labels"],
    "Published": ["published"],
    "Status": ["status"],
    "Option1 Name": ["option1 name"], "Option1 Value": ["option1 value"],
    "Option2 Name": ["option2 name"], "Option2 Value": ["option2 value"],
    "Option3 Name": ["option3 name"], "Option3 Value": ["option3 value"],
    "Variant SKU": [
        "sku", "sku code", "item code", "item number", "product code", "product number", "article number",
        "article code", "variant sku",
    ],
    "Variant Grams": ["weight", "grams", "weight in grams"],
    "Variant Inventory Tracker": ["inventory tracker", "tracker"],
    "Variant Inventory Qty": [
        "qty", "quantity", "stock", "on hand", "available", "inventory", "inventory qty",
        "inventory quantity", "stock quantity", "stock level", "quantity available",
    ],
    "Variant Inventory Policy": ["inventory policy"],
    "Variant Fulfillment Service": ["fulfillment service"],
    "Variant Price": [
        "price", "cost", "item price", "retail price", "unit price", "sale price", "selling price",
        "regular price", "product price",
    ],
    "Variant Compare At Price": [
        "compare at price", "compare price", "compare-at price", "msrp", "list price", "was price",
        "original price",
    ],
    "Variant Barcode": ["barcode", "ean", "upc", "gtin", "isbn"],
    "Image Src": [
        "image", "image url", "image src", "photo", "photo url", "picture", "picture url", "image link",
        "main image", "product image",
    ],
    "SEO Title": ["seo title", "meta title", "page title"],
    "SEO Description": ["seo description", "meta description"],
}
ALIAS_TO_COLUMN = {alias: column for column, names in ALIASES.items() for alias in names}

# Category and label of the fields named in a comparison.
FIELD_CATEGORIES = {
    "Variant Price": ("price", "price"),
    "Variant Compare At Price": ("price", "compare-at price"),
    "Cost per item": ("price", "cost"),
    "Variant Inventory Qty": ("inventory", "inventory"),
    "Title": ("identity", "title"),
    "Handle": ("identity", "handle"),
    "Variant SKU": ("identity", "SKU"),
    "Body (HTML)": ("content", "description"),
    "SEO Title": ("content", "SEO title"),
    "SEO Description": ("content", "SEO description"),
    "Image Src": ("content", "image"),
    "Vendor": ("metadata", "vendor"),
    "Type": ("metadata", "type"),
    "Tags": ("metadata", "tags"),
    "Published": ("metadata", "published status"),
    "Status": ("metadata", "status"),
    "Product Category": ("metadata", "category"),
}

# Rule code -> (severity, fix class, name shown when nothing was found).
RULES = {
    "DELIMITER_NOT_COMMA": ("critical", "review", "File uses comma delimiter"),
    "FILE_SIZE_APPROACHING_LIMIT": ("info", "never", None),
    "FILE_SIZE_OVER_LIMIT": ("critical", "review", None),
    "ENCODING_BOM_PRESENT": ("warning", "auto", "No byte-order mark detected"),
    "ENCODING_NOT_UTF8": ("warning", "auto", "File encoding is UTF-8"),
    "SMART_QUOTES_DETECTED": ("warning", "auto", "No smart quotes detected"),
    "CELL_WHITESPACE": ("warning", "auto", "No stray whitespace in text cells"),
    "HEADER_REQUIRED_MISSING": ("critical", "never", None),
    "HEADER_UNKNOWN_COLUMN": ("warning", "never", None),
    "HEADER_DUPLICATE": ("critical", "review", "No duplicate headers"),
    "TITLE_MISSING": ("critical", "never", "All products have a Title"),
    "HANDLE_MISSING_NEW": ("warning", "review", None),
    "HANDLE_MISSING_UPDATE": ("critical", "never", None),
    "HANDLE_FORMAT_INVALID": ("warning", "auto", None),
    "HANDLE_DUPLICATE_IN_FILE": ("critical", "never", "No conflicting duplicate handles"),
    "SKU_DUPLICATE_IN_FILE": ("critical", "review", None),
    "SKU_WHITESPACE": ("warning", "auto", "No whitespace in SKUs"),
    "DUPLICATE_IDENTICAL_ROWS": ("warning", "review", "No identical duplicate rows"),
    "DESTRUCTIVE_BLANK_ALL_ROWS": ("info", "auto", None),
    "DESTRUCTIVE_BLANK_INCLUDED_COLUMN": ("critical", "never", None),
    "VARIANT_ORPHANED": ("critical", "never", "No orphaned variant rows"),
    "VARIANT_OPTION_NAME_INCONSISTENT": ("critical", "never", None),
    "VARIANT_DUPLICATE_OPTION_COMBINATION": ("critical", "never", "No duplicate variant option combinations"),
    "VARIANT_PARTIAL_COLLAPSE": ("critical", "never", "All option rows have matching Name and Value"),
    "VARIANT_COLUMN_INCONSISTENCY": ("critical", "never", "Variant option columns consistent across rows"),
    "IMAGE_ROW_VARIANT_DATA": ("critical", "review", "No image rows with stray variant data"),
    "SINGLE_VARIANT_MULTIPLE_IMAGES": (
        "critical", "review", "Single-variant products with images are properly configured",
    ),
    "DUPLICATE_IMAGE_ROWS": ("warning", "auto", "No duplicate image rows"),
    "INVENTORY_QTY_MISSING_WITH_TRACKER": ("warning", "review", "All rows with inventory tracker have a quantity"),
    "INVENTORY_TRACKER_MISSING": ("warning", "never", "Inventory tracker set on all rows with quantity"),
    "BOOLEAN_FORMAT": ("warning", "auto", "All boolean columns use TRUE/FALSE"),
    "PRODUCT_CATEGORY_FORMAT": ("info", "never", "All Product Category values look valid"),
    "ROW_ORDER_WARNING": ("info", "never", "Variant rows grouped by Handle"),
    "PRICE_CURRENCY_SYMBOL": ("warning", "auto", None),
    "PRICE_DECIMAL_COMMA": ("warning", "review", None),
    "PRICE_NON_NUMERIC": ("warning", "never", "All prices numeric"),
    "PRICE_NEGATIVE": ("warning", "never", None),
    "COMPARE_AT_PRICE_LOWER_THAN_PRICE": ("critical", "never", "Compare-at prices are consistent with prices"),
    "INVENTORY_NON_INTEGER": ("warning", "never", "All inventory values are integers"),
    "INVENTORY_NEGATIVE": ("warning", "never", None),
    "HTML_UNCLOSED_TAG": ("warning", "review", "No unclosed HTML tags"),
    "HTML_DANGEROUS_ATTRIBUTE": ("warning", "never", None),
    "IMAGE_URL_NOT_HTTPS": ("warning", "review", "All image URLs use HTTPS"),
    "IMAGE_URL_MALFORMED": ("warning", "never", None),
    "IMAGE_URL_PRIVATE_CDN": ("warning", "never", None),
    "IMAGE_URL_NO_EXTENSION": ("warning", "never", None),
    "STATUS_INVALID_VALUE": ("warning", "never", "All status values valid"),
    "FIELD_COUNT_MISMATCH": ("info", "never", None),
}
