"""Built-in indicator tables (S10): small, fixed, checked in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values (must equal the reference's built-in lists) ------------------
BUILTIN_SAFE_DOMAINS = [
    "google.com", "www.google.com", "googleapis.com", "gstatic.com",
    "microsoft.com", "windows.com", "office.com", "windows.net",
    "windowsupdate.com", "azure.com", "azureedge.net", "live.com",
    "outlook.com", "teams.microsoft.com", "facebook.com", "fbcdn.net",
    "cloudflare.com", "cloudfront.net", "amazonaws.com", "apple.com",
    "icloud.com", "github.com", "linkedin.com", "twitter.com",
    "baidu.com", "www.baidu.com", "bdstatic.com", "baidubce.com",
    "aliyun.com", "aliyuncs.com", "alipay.com", "alipayobjects.com",
    "taobao.com", "tmall.com", "alicdn.com", "tbcdn.cn",
    "qq.com", "qqzhi.com", "qlogo.cn", "gtimg.cn", "qpic.cn",
    "weixin.qq.com", "wx.qq.com", "work.weixin.qq.com",
    "163.com", "126.net", "127.net", "netease.com",
    "sina.com.cn", "sinaimg.cn", "weibo.com", "weibo.cn",
    "jd.com", "360buyimg.com", "jdcloud.com",
    "huawei.com", "hicloud.com", "vmall.com",
    "mi.com", "miui.com", "xiaomi.com", "xiaomi.cn",
    "douyin.com", "douyinvod.com", "douyinpic.com", "douyinstatic.com",
    "kuaishou.com", "kuaishouzt.com", "gifshow.com",
    "bilibili.com", "bilivideo.com", "biliapi.net", "hdslb.com",
    "zhihu.com", "zhimg.com",
    "tencent.com", "tencent-cloud.net", "qcloud.com",
    "cdn-go.cn", "gtimg.com", "idqqimg.com",
    "alikunlun.com", "alikunlun.net", "cdngslb.com", "alibabacloud.com",
    "myqcloud.com", "tencentclb.com", "tencentcos.cn",
    "huaweicloud.com", "myhuaweicloud.com", "huaweicloud.cn", "hwcdn.net",
]
BUILTIN_SUSPICIOUS_UA = [
    "python-requests", "python-urllib", "python-httpx",
    "curl", "wget", "powershell", "pwsh",
    "go-http-client", "java/", "libwww-perl",
    "nikto", "sqlmap", "nmap", "masscan", "dirbuster",
    "gobuster", "wfuzz", "hydra", "metasploit",
]
BUILTIN_PHISHING_KEYWORDS = [
    "login", "secure", "account", "verify", "update", "confirm",
    "banking", "paypal", "apple-id", "microsoft-account", "signin",
    "password-reset", "credential", "authenticate", "authorize",
    "登录", "验证", "更新", "确认", "安全中心", "账号异常",
    "冻结", "解冻", "重置密码", "实名认证", "人脸识别",
]
# The detector's own safe list (configuration default, 25 names).
DEFAULT_SAFE_DOMAINS = [
    "google.com", "www.google.com", "googleapis.com",
    "microsoft.com", "windows.com", "msftconnecttest.com",
    "apple.com", "icloud.com", "mzstatic.com",
    "amazon.com", "amazonaws.com", "cloudfront.net",
    "facebook.com", "fbcdn.net", "twitter.com", "twimg.com",
    "cloudflare.com", "cdnjs.cloudflare.com",
    "github.com", "githubusercontent.com",
    "linkedin.com", "licdn.com",
    "akamai.net", "akamaiedge.net", "fastly.net",
]
BUILTIN_SOURCES = [
    ("builtin_safe_domains", "whitelist_domains", BUILTIN_SAFE_DOMAINS),
    ("builtin_suspicious_ua", "suspicious_user_agents", BUILTIN_SUSPICIOUS_UA),
    ("builtin_phishing_keywords", "phishing_keywords", BUILTIN_PHISHING_KEYWORDS),
]
# ------------------------------------------------------------------------------


def builtin_indicators(spark: SparkSession) -> DataFrame:
    """``(source, category, value)`` rows of the three built-in sources."""
    rows = [(src, cat, v) for src, cat, items in BUILTIN_SOURCES for v in items]
    return spark.createDataFrame(rows, "source string, category string, value string")


def builtin_feeds(spark: SparkSession) -> DataFrame:
    """Feed-catalog rows for the built-in sources (always enabled and healthy)."""
    rows = [(src, cat, "generated", True, "healthy", 0) for src, cat, _ in BUILTIN_SOURCES]
    return spark.createDataFrame(
        rows, "source string, category string, source_type string, enabled boolean, health string, expiry_hours int")


def default_safe_domains(spark: SparkSession, extra_file: str | None = None) -> DataFrame:
    """The configuration safe list plus an optional one-name-per-line file."""
    base = spark.createDataFrame([(d,) for d in DEFAULT_SAFE_DOMAINS], "value string")
    if extra_file:
        from pyspark.sql import functions as F
        extra = (spark.read.text(extra_file)
                 .select(F.lower(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
                 .where((F.col("value") != "") & ~F.col("value").startswith("#")))
        base = base.unionByName(extra).distinct()
    return base
