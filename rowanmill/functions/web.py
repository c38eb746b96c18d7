"""What can be told of a web page by patterns alone: technologies, delivery, order method, phones, crawl errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import strip

# Marks of technologies and services in a page's source.
TECHNOLOGIES = {
    "WordPress": r"wp-content|wp-includes|wordpress",
    "WooCommerce": r"woocommerce|wc-add-to-cart",
    "Shopify": r"cdn\.shopify\.com|shopify\.myshopify\.com|Shopify\.theme",
    "Wix": r"wixstatic\.com|wix\.com|_wix_",
    "Squarespace": r"squarespace\.com|sqsp|static1\.squarespace\.com",
    "Webflow": r"webflow\.com|data-wf-page|webflow\.js",
    "Magento": r"mage/cache|magento|Mage\.Cookies",
    "Cloudflare": r"cloudflare|cf-beacon|cf[-_]\w+",
    "React": r"react\.js|data-reactroot",
    "Next.js": r"__next|next\.data",
    "Vue": r"vue\.js|data-vue",
}
GENERATORS = {"WordPress": "wordpress", "Shopify": "shopify", "Magento": "magento", "Wix": "wix", "Squarespace": "squarespace", "Webflow": "webflow"}
PROVIDERS = {
    "Deliveroo": r"deliveroo",
    "Uber Eats": r"ubereats|uber\.com/eats",
    "Foodpanda": r"foodpanda",
    "Just Eat": r"just-eat|justeat",
    "DoorDash": r"doordash",
    "Careem": r"careem",
    "Bykea": r"bykea",
    "Zomato": r"zomato",
    "Talabat": r"talabat",
    "In-house Delivery": r"home delivery|doorstep delivery|free delivery|express delivery|our delivery",
    "Collection / Pickup": r"click and collect|store pickup|curbside pickup|collection|takeaway",
}
CART = r"add to cart|add-to-cart|checkout|buy now|shopping cart|view cart|place order"
CHAT, CHAT_ORDER = r"wa\.me|api\.whatsapp\.com|whatsapp", r"order|buy|catalog|price|chat to order"
CALL = r"tel:|call to order|phone order|order by phone|call for delivery"
SHOPS = ("Magento", "Shopify", "WooCommerce")
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?\d{1,4}[-.\s]?\(?\d{1,5}\)?[-.\s]?\d{3,5}[-.\s]?\d{3,5}"
CRAWL_ERRORS = (
    ("DNS Failure", ("err_name_not_resolved", "name or service not known", "gaierror", "nodename nor servname")),
    ("Timeout", ("timeout", "timed out")),
    ("HTTP 404", ("404",)),
    ("HTTP 403", ("403",)),
    ("SSL Error", ("ssl", "certificate_verify_failed", "cert")),
    ("Unreachable", ("err_connection_refused", "connecterror", "connection refused", "unreachable")),
)
SOCIAL_SITES = ("facebook.com", "fb.com", "instagram.com", "linktr.ee", "tiktok.com", "twitter.com", "wa.me", "whatsapp.com", "x.com")


def has(html: Column, pattern: str) -> Column:
    return F.coalesce(html.rlike(f"(?i){pattern}"), F.lit(False))


def _named(flags: dict[str, Column]) -> Column:
    """Names whose flag is set, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(flag, name) for name, flag in flags.items()])))


def generator(html: Column) -> Column:
    """The content of the generator meta tag, with its attributes in either order."""
    tag = F.regexp_extract(html, r"(?is)<meta\s[^>]*name\s*=\s*[\"']?generator[\"'\s][^>]*>", 0)
    return F.lower(F.regexp_extract(tag, r"(?is)content\s*=\s*[\"']([^\"']*)", 1))


def technologies(html: Column) -> Column:
    made = generator(html)
    return _named({name: has(html, p) | F.coalesce(made.contains(GENERATORS[name]), F.lit(False)) if name in GENERATORS else has(html, p) for name, p in TECHNOLOGIES.items()})


def delivery_providers(html: Column) -> Column:
    return _named({name: has(html, p) for name, p in PROVIDERS.items()})


def ordering(html: Column, techs: Column, providers: Column) -> Column:
    """Struct of order_method, order_method_detail and delivery_system: a shop or cart, then chat orders, delivery apps, phone, else walk-in."""
    shop = F.get(F.filter(techs, lambda t: t.isin(*SHOPS)), F.lit(0))
    sells = shop.isNotNull() | has(html, CART)
    apps = F.array_join(providers, ", ")
    delivers = F.when(F.size(providers) > 0, apps).when(sells, "In-house Delivery").otherwise("None")
    chat = has(html, CHAT) & has(html, CHAT_ORDER)
    method = F.when(sells | chat | (F.size(providers) > 0), "online").when(has(html, CALL), "phone").otherwise("in_person")
    detail = (
        F.when(sells, F.concat(F.lit("Online (Add to Cart / "), F.coalesce(shop, F.lit("E-Commerce")), F.lit(")")))
        .when(chat, "WhatsApp Ordering")
        .when(F.size(providers) > 0, F.concat(F.lit("Delivery Apps ("), apps, F.lit(")")))
        .when(has(html, CALL), "Phone Order")
        .otherwise("Walk-in / In-Person")
    )
    return F.struct(method.alias("order_method"), detail.alias("order_method_detail"), delivers.alias("delivery_system"))


def clean_phone(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(x), r"(?U)\s+", " "), r" *- *", "-")


def valid_phone(x: Column) -> Column:
    """7 to 15 digits of more than two kinds, and neither a date nor three or more numbers up to 255."""
    text = strip(x)
    digits = F.regexp_replace(text, r"\D", "")
    date = text.rlike(r"^\d{4}[-/.]\d{2}[-/.]\d{2}$") | text.rlike(r"^\d{2}[-/.]\d{2}[-/.]\d{4}$")
    parts = F.split(text, r"\s+")
    octets = (F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(r"^0*(25[0-5]|2[0-4]\d|1?\d{1,2})$"))
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    return F.length(digits).between(7, 15) & ~date & ~octets & (kinds > 2)


def phones_in(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), clean_phone)
    return F.array_sort(F.array_distinct(F.filter(found, valid_phone)))


def emails_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))))


def page_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def crawl_error(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, marks in CRAWL_ERRORS:
        hit = reduce(lambda a, b: a | b, [low.contains(m) for m in marks])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.concat(F.lit("Failed ("), F.left(text, F.lit(30)), F.lit(")")))


def with_scheme(url: Column) -> Column:
    text = strip(url)
    return F.when(text.startswith("http://") | text.startswith("https://"), text).otherwise(F.concat(F.lit("https://"), text))


def social_site(url: Column) -> Column:
    """The social network that the site itself is on.  Dropping every 'm.' turns instagram.com into instagracom, which is kept as it is."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.replace(F.replace(host, F.lit("www."), F.lit("")), F.lit("m."), F.lit(""))
    out = F.when(host.contains(SOCIAL_SITES[0]), SOCIAL_SITES[0])
    for site in SOCIAL_SITES[1:]:
        out = out.when(host.contains(site), site)
    return out


def unfenced(reply: Column) -> Column:
    """A model's reply without its code fence."""
    return strip(F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", ""))
