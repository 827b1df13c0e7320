"""Environment, domain and work type of documents, by rules over titles, bodies, paths and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import first_match

# Rules in order, the first that matches counts.
ENVIRONMENTS = (
    ("csp", r"(?i)\bSCP\b|SKE|PaaS"),
    ("onprem", r"(?i)온프레|on-?prem|베어메탈|IDC"),
    ("msp", r"(?i)\bMSP\b|운영대행"),
    ("hybrid", r"(?i)서비스\s*메시|service\s*mesh|Istio|Linkerd|사이드카|sidecar|mTLS"),
    ("hybrid", r"(?i)쿠버네티스|Kubernetes|\bk8s\b|파드\s*IP|ClusterIP"),
)
DOMAINS = (
    ("os", r"(?i)Linux|리눅스|kernel|sysctl|OS hang"),
    ("dbms", r"(?i)Oracle|HANA|MySQL|Tibero|Postgre|DB2|Greenplum|GPDB|SQL"),
    ("storage", r"(?i)스토리지|NetApp|Ceph|NAS|SAN|disk latency|multipath"),
    ("network", r"(?i)네트워크|NIC|MTU|VXLAN|GRO|LB|방화벽|NSX"),
    ("virtualization", r"(?i)VMware|ESXi|vCenter|가상화"),
    ("middleware", r"(?i)Kubernetes|k8s|K8S|SKE|Redis|WAS|Tomcat|WebLogic"),
    ("cloud", r"(?i)클라우드|SCP"),
)
PATHS = (("운영체제", "os"), ("데이터베이스", "dbms"), ("스토리지", "storage"), ("미들웨어", "middleware"), ("클라우드", "cloud"), ("네트워크", "network"), ("GPU", "gpu"))
BUCKET_DOMAINS = (("network", "network"), ("cluster", "os"), ("windows", "os"))
CLOSED = ("닫힘", "Resolved", "Done")


def _blob(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(3000)))


def environment(title: Column, body: Column) -> Column:
    return first_match(_blob(title, body), list(ENVIRONMENTS), None)


def domain_of_path(path: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(path, F.lit(k)), F.lit(v)) for k, v in PATHS])


def domain(title: Column, body: Column, path: Column, source_type: Column, area: Column, bucket_domain: Column) -> Column:
    """By the path, by a check item's area, by a bucket's domain, else by the text."""
    item = F.when((source_type == "checkitem") & (area != ""), F.replace(F.lower(area), F.lit(" "), F.lit("_")))
    bucket = F.coalesce(*[F.when((source_type == "failure_bucket") & (F.lower(bucket_domain) == k), F.lit(v)) for k, v in BUCKET_DOMAINS])
    return F.coalesce(domain_of_path(path), item, bucket, first_match(_blob(title, body), list(DOMAINS), None))


def given(value: Column, inferred: Column) -> Column:
    """An explicit value counts before an inferred one."""
    return F.coalesce(F.nullif(value, F.lit("")), inferred)


def grade(status: Column) -> Column:
    return F.when(status.isin(*CLOSED), "A").otherwise("B")
