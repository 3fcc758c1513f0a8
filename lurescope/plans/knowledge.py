"""Fixed values that triage results depend on. Brands and lure phrases are inputs, as organisations add their own."""

#: Link shorteners, by registrable domain.
SHORTENERS = (
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "rb.gy", "shorturl.at", "tiny.cc", "t.ly",
    "lnkd.in", "s.id", "bl.ink", "short.io", "qrco.de", "tr.im", "geni.us", "vk.cc", "vk.sv", "clck.ru", "v.gd", "bit.do", "surl.li", "urlz.fr",
    "u.to", "tiny.one", "shorturl.asia", "t2m.io", "forms.gle",
)
#: Extensions of files that run or open a page, and of archives.
RISKY_EXTENSIONS = (
    "html", "htm", "shtml", "xhtml", "hta", "js", "jse", "vbs", "vbe", "wsf", "ps1", "bat", "cmd", "com", "exe", "scr", "pif", "cpl", "msi", "jar",
    "lnk", "iso", "img", "vhd", "vhdx", "one", "chm", "reg", "docm", "xlsm", "pptm", "xlam", "dotm", "xll", "svg", "url", "appx",
)
ARCHIVE_EXTENSIONS = ("zip", "rar", "7z", "gz", "tar", "cab", "ace", "arj", "tgz")
#: Extensions of files that a link may download, run at once or packed.
RUNNABLE_DOWNLOADS = (
    "exe", "scr", "js", "jse", "vbs", "vbe", "wsf", "hta", "msi", "bat", "cmd", "ps1", "lnk", "iso", "img", "vhd", "vhdx", "jar", "one", "appx", "msix",
    "cpl",
)
PACKED_DOWNLOADS = ("zip", "rar", "7z", "apk", "dmg", "gz", "tgz", "cab", "ace", "arj")
#: Top-level domains of much abuse, and names that no public resolver has.
SUSPICIOUS_TLDS = (
    "zip", "mov", "xyz", "top", "click", "link", "icu", "cfd", "rest", "gq", "tk", "ml", "cf", "ga", "work", "fit", "monster", "quest", "sbs", "buzz",
    "live", "shop", "online", "site", "store", "cam", "lol", "ru", "su", "cyou",
)
PRIVATE_TLDS = ("internal", "local", "localhost", "localdomain", "lan", "home", "corp", "mail", "test", "example", "invalid", "arpa")
#: Words in a path or query of a page that asks for credentials.
CREDENTIAL_WORDS = (
    "login", "signin", "sign-in", "logon", "verify", "verification", "password", "passwd", "authenticate", "recover", "unlock", "validate", "wallet",
    "mfa", "otp", "webmail", "owa", "office365", "o365", "sso", "credential",
)
#: Free-mail providers, and mail services that many senders share, by registrable domain.
FREEMAIL = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "ymail.com", "icloud.com", "me.com", "aol.com",
    "proton.me", "protonmail.com", "gmx.com", "gmx.de", "mail.com", "yandex.ru", "yandex.com", "zoho.com", "mail.ru", "rediffmail.com", "tutanota.com",
    "163.com", "126.com", "yeah.net", "qq.com", "foxmail.com", "sina.com", "naver.com", "daum.net", "hanmail.net", "web.de", "libero.it", "seznam.cz",
    "inbox.ru", "bk.ru", "list.ru", "rambler.ru",
)
SHARED_INFRASTRUCTURE = (
    "sendgrid.net", "mailgun.org", "mailgun.net", "mcsv.net", "rsgsv.net", "mcdlv.net", "list-manage.com", "mandrillapp.com", "sparkpostmail.com",
    "postmarkapp.com", "mtasv.net", "sendinblue.com", "mailjet.com", "exacttarget.com", "createsend.com", "cmail19.com", "cmail20.com", "rs6.net",
    "hubspotemail.net", "klaviyomail.com", "zcsend.net", "maillist-manage.com", "oracleemaildelivery.com", "oraclecloud.com",
)
#: Words of a display name that speaks for an organisation.
ORG_WORDS = (
    "bank", "team", "support", "service", "services", "security", "account", "accounts", "billing", "helpdesk", "admin", "administrator", "notification",
    "notifications", "it", "hr", "payroll", "delivery", "customer", "official", "department", "desk", "compliance", "finance", "webmail", "mailbox",
    "protocolo", "atendimento", "suporte", "soporte", "servicio", "kundenservice", "equipe", "equipo",
)
#: Ends of hosts that anyone gets for nothing, of tunnels, gateways by name, and file sharing by host and path.
FREE_HOSTING = (
    ".web.app", ".firebaseapp.com", ".pages.dev", ".workers.dev", ".r2.dev", ".netlify.app", ".vercel.app", ".glitch.me", ".github.io", ".blogspot.com",
    ".weebly.com", ".wixsite.com", ".webflow.io", ".square.site", ".godaddysites.com", ".000webhostapp.com", ".azurewebsites.net",
    ".web.core.windows.net", ".onrender.com", ".replit.app", ".repl.co", ".herokuapp.com", ".fly.dev", ".surge.sh", ".mybluehost.me",
    ".framer.website", ".carrd.co",
)
TUNNELS = (".ngrok-free.app", ".ngrok.io", ".ngrok.app", ".trycloudflare.com", ".loca.lt", ".ipfs.dweb.link", ".ipfs.w3s.link", ".ipfs.nftstorage.link")
IPFS_GATEWAYS = ("ipfs.io", "cloudflare-ipfs.com", "gateway.pinata.cloud", "dweb.link", "w3s.link")
FILE_SHARING = (
    ("drive.google.com", ("/uc", "/file/", "/open")), ("docs.google.com", ("/forms/",)), ("storage.googleapis.com", ("/",)),
    ("firebasestorage.googleapis.com", ("/",)), ("sites.google.com", ("/",)), ("dropbox.com", ("/s/", "/scl/", "/t/")),
    ("dl.dropboxusercontent.com", ("/",)), ("1drv.ms", ("/",)), ("onedrive.live.com", ("/",)), ("we.tl", ("/",)),
    ("wetransfer.com", ("/downloads/",)), ("mega.nz", ("/",)), ("mediafire.com", ("/file/", "/download/")), ("forms.office.com", ("/",)),
    ("jotform.com", ("/",)),
)
#: Zones whose customers each get a name under them.
KNOWN_PLATFORMS = (
    "sa.com", "eu.com", "us.com", "uk.com", "gb.net", "za.com", "it.com", "br.com", "cn.com", "de.com", "jpn.com", "ru.com", "in.net", "us.org",
    "ae.org", "co.com", "co.ua", "com.ua", "run.app", "appspot.com", "cloudfunctions.net", "cloudfront.net", "azureedge.net", "zendesk.com",
    "freshdesk.com", "atlassian.net", "sharepoint.com", "myshopify.com", "wordpress.com", "secureserver.net", "force.com", "site.com", "notion.site",
)
#: The true types that a file's extension may have, and types whose disguise matters.
EXPECTED_TYPES = {
    "pdf": ("pdf",), "doc": ("ole",), "xls": ("ole",), "ppt": ("ole",), "msg": ("ole",), "docx": ("zip",), "xlsx": ("zip",), "pptx": ("zip",),
    "docm": ("zip",), "xlsm": ("zip",), "odt": ("zip",), "zip": ("zip",), "jar": ("zip",), "rar": ("rar",), "7z": ("7z",), "exe": ("pe",),
    "dll": ("pe",), "scr": ("pe",), "png": ("png",), "jpg": ("jpeg",), "jpeg": ("jpeg",), "gif": ("gif",), "html": ("html",), "htm": ("html",),
    "svg": ("svg", "html"), "iso": ("iso",), "txt": (), "csv": (), "eml": (), "one": ("onenote",), "lnk": ("lnk",), "img": ("fatimg", "iso"),
    "vhd": ("vhd",), "vhdx": ("vhd",), "rtf": ("rtf",), "gz": ("gzip",), "tgz": ("gzip",), "tar": ("tar",), "cab": ("cab",), "dat": ("tnef",),
    "ics": ("calendar",), "msi": ("ole",), "xlsb": ("zip",), "pptm": ("zip",), "dotm": ("zip",),
}
DANGEROUS_TYPES = ("pe", "elf", "html", "iso", "zip", "rar", "7z", "svg", "lnk", "onenote", "fatimg", "vhd", "ole", "cab")
