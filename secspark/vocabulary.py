"""Values that the data model fixes: categories, actions, source types, shipped parsers, connector presets."""

from __future__ import annotations

MODEL_VERSION = "1.3"

# Categories of the event model, signals first, telemetry after them.
CATEGORIES = [
    "firewall", "ids", "alert", "web", "malware", "auth", "dns", "mail", "dlp", "vpn", "application", "endpoint", "network", "data", "tamper", "vuln", "utm", "posture", "exec", "secrets", "account", "recon",
    "postscreen", "reject", "mailflow", "mail-phishing", "mail-url", "health", "config", "audit", "system", "update", "container", "k8s", "ebpf", "ban", "integrity", "syslog", "inventory", "trace",
]

# Actions of the event model.
ACTIONS = ["success", "failure", "allowed", "blocked", "ban", "read", "modify", "delete", "sudo", "session_open", "session_close"]

# Source types of collector records, by category.
_SOURCETYPES = {
    "web": ["access_combined", "access_common", "access_combined_wcookie", "apache:access", "apache_access", "nginx:access", "nginx_access", "iis", "ms:iis", "httpd"],
    "auth": ["linux_secure", "secure", "auth", "authpriv", "pam", "sshd", "openssh", "wineventlog:security", "winsecurity", "xmlwineventlog:security"],
    "firewall": ["cisco:asa", "cisco_asa", "pan:traffic", "pan:firewall", "fortigate", "fortinet", "checkpoint", "iptables", "pf", "ufw"],
    "ids": ["suricata", "snort", "bro:notice", "zeek:notice", "cisco:ips"],
    "dns": ["dns", "bro:dns", "zeek:dns", "named", "bind", "isc:bind:query"],
    "mail": ["postfix_syslog", "sendmail_syslog", "cisco:esa", "exchange", "ms:exchange"],
    "system": ["wineventlog:system", "winsystem"],
    "application": ["wineventlog:application", "winapp"],
    "endpoint": ["wineventlog", "sysmon", "xmlwineventlog:microsoft-windows-sysmon/operational", "linux:audit", "auditd", "osquery:results"],
    "syslog": ["syslog", "rfc5424", "rfc3164"],
    "container": ["docker", "container", "kube:container"],
    "k8s": ["kube:apiserver", "kubernetes", "k8s"],
}
SOURCETYPE_CATEGORY = {x: category for category, names in _SOURCETYPES.items() for x in names}

# The shipped declarative parsers and the shipped regex parser (source, pattern).
PARSER_SPECS = [
    {
        "source": "cloudflare", "guard": r'"clientIP"', "extract": [{"json": True}],
        "map": {
            "category": "firewall", "severity": 2, "action": "$action", "src_ip": "$clientIP", "fields.vhost": "$clientRequestHTTPHost", "fields.path": "$clientRequestPath", "fields.cf_source": "$source",
            "fields.cf_rule": "$ruleId", "fields.cf_ua": "$userAgent", "fields.cf_country": "$clientCountryName",
        },
    },
    {
        "source": "firewall", "guard": r"\b(?:action|act)=", "extract": [{"kv": True}],
        "map": {"category": "firewall", "severity": 2, "action": "$action", "src_ip": "$src", "dst_ip": "$dst", "url": "$url", "fields.proto": "$proto", "fields.dport": "$dport", "fields.vendor": "$devname"},
    },
    {
        "source": "fim-agent", "guard": r"\bevent=(?:added|modified|deleted)\b", "extract": [{"kv": True}],
        "map": {"category": "integrity", "action": "$action", "fields.fim_path": "$path", "fields.fim_event": "$event", "fields.fim_mode": "$mode", "fields.fim_sha256": "$sha256", "fields.fim_actor": "$actor"},
    },
    {
        "source": "nft", "guard": r"PORTSCAN[46]?:",
        "extract": [{"regex": r"(?:^|\s)SRC=(?P<src>[0-9A-Fa-f.:]+)"}, {"regex": r"(?:^|\s)DST=(?P<dst>[0-9A-Fa-f.:]+)"}, {"regex": r"(?:^|\s)DPT=(?P<dpt>[0-9]+)"}, {"regex": r"(?:^|\s)PROTO=(?P<proto>[A-Za-z0-9_-]+)"}],
        "map": {"category": "firewall", "severity": 2, "action": "deny", "src_ip": "$src", "dst_ip": "$dst", "fields.dst_port": "$dpt", "fields.proto": "$proto", "fields.signal": "portscan"},
    },
]
REGEX_PARSERS = [("nginx", r'"(?P<method>[A-Z]+) (?P<path>\S+) HTTP/[\d.]+" (?P<status>\d{3}) (?P<bytes>\d+)')]

# Connector presets: where the records stand, and which path gives which field ("=" is a constant).
PRESETS = {
    "aws-cloudtrail": {"records": "Records", "source": "aws-cloudtrail", "categories": {"cloudtrail": "audit"}, "fields": {"id": "eventID", "ts": "eventTime", "message": "eventName", "src_ip": "sourceIPAddress", "sourcetype": "=cloudtrail", "fields.user": "userIdentity.arn", "fields.user_name": "userIdentity.userName", "fields.user_type": "userIdentity.type", "fields.event_source": "eventSource", "fields.aws_region": "awsRegion", "fields.account_id": "recipientAccountId", "fields.action": "errorCode", "fields.error_message": "errorMessage", "fields.read_only": "readOnly", "fields.user_agent": "userAgent"}},
    "aws-guardduty": {"records": "", "source": "aws-guardduty", "categories": {"guardduty": "ids"}, "fields": {"id": "Id", "ts": "UpdatedAt", "severity": "Severity", "message": "Title", "src_ip": "Service.Action.NetworkConnectionAction.RemoteIpDetails.IpAddressV4", "sourcetype": "=guardduty", "fields.finding_type": "Type", "fields.description": "Description", "fields.aws_region": "Region", "fields.account_id": "AccountId", "fields.resource_type": "Resource.ResourceType", "fields.action": "Service.Action.ActionType", "fields.count": "Service.Count"}},
    "cloudflare-audit": {"records": "result", "source": "cloudflare", "categories": {"cloudflare:audit": "audit"}, "fields": {"id": "id", "ts": "when", "message": "action.type", "src_ip": "actor.ip", "sourcetype": "=cloudflare:audit", "fields.user": "actor.email", "fields.actor_type": "actor.type", "fields.action": "action.result", "fields.resource_type": "resource.type", "fields.resource_id": "resource.id", "fields.metadata": "metadata"}},
    "crowdstrike-falcon": {"records": "resources", "source": "crowdstrike", "categories": {"falcon:detection": "malware"}, "fields": {"id": "composite_id", "ts": "created_timestamp", "severity": "severity_name", "message": "description", "host": "device.hostname", "src_ip": "device.local_ip", "sourcetype": "=falcon:detection", "fields.tactic": "tactic", "fields.technique": "technique", "fields.technique_id": "technique_id"}},
    "gcp-audit": {"records": "entries", "source": "gcp-audit", "categories": {"gcp:audit": "audit"}, "fields": {"id": "insertId", "ts": "timestamp", "message": "protoPayload.methodName", "src_ip": "protoPayload.requestMetadata.callerIp", "sourcetype": "=gcp:audit", "fields.user": "protoPayload.authenticationInfo.principalEmail", "fields.service": "protoPayload.serviceName", "fields.resource": "protoPayload.resourceName", "fields.resource_type": "resource.type", "fields.action": "protoPayload.status.code", "fields.status_message": "protoPayload.status.message", "fields.user_agent": "protoPayload.requestMetadata.callerSuppliedUserAgent", "fields.log_name": "logName"}},
    "generic-rest": {"records": "results", "source": "example-rest", "categories": {"example:alert": "ids"}, "fields": {"id": "uuid", "ts": "timestamp", "severity": "severity", "message": "title", "host": "asset.hostname", "src_ip": "network.source_ip", "dst_ip": "network.dest_ip", "url": "network.url", "sourcetype": "=example:alert", "fields.category": "category", "fields.rule_name": "detection.rule_name"}},
    "google-workspace": {"records": "items", "source": "google-workspace", "categories": {"gsuite:login": "auth"}, "fields": {"id": "id.uniqueQualifier", "ts": "id.time", "message": "events[0].name", "src_ip": "ipAddress", "sourcetype": "=gsuite:login", "fields.user": "actor.email", "fields.actor_profile_id": "actor.profileId", "fields.event_type": "events[0].type", "fields.event_name": "events[0].name", "fields.application": "id.applicationName"}},
    "m365-entra-audit": {"records": "value", "source": "entra-id", "categories": {"entra:audit": "audit"}, "fields": {"id": "id", "ts": "activityDateTime", "message": "activityDisplayName", "sourcetype": "=entra:audit", "fields.user": "initiatedBy.user.userPrincipalName", "fields.actor_app": "initiatedBy.app.displayName", "src_ip": "initiatedBy.user.ipAddress", "fields.action": "result", "fields.result_reason": "resultReason", "fields.category": "category", "fields.operation": "operationType", "fields.target": "targetResources[0].displayName", "fields.target_type": "targetResources[0].type"}},
    "m365-entra-signin": {"records": "value", "source": "entra-id", "categories": {"entra:signin": "auth"}, "fields": {"id": "id", "ts": "createdDateTime", "severity": "riskLevelDuringSignIn", "message": "appDisplayName", "src_ip": "ipAddress", "sourcetype": "=entra:signin", "fields.user": "userPrincipalName", "fields.user_display": "userDisplayName", "fields.action": "status.errorCode", "fields.failure_reason": "status.failureReason", "fields.app_id": "appId", "fields.client_app": "clientAppUsed", "fields.risk_state": "riskState", "fields.city": "location.city", "fields.country": "location.countryOrRegion", "fields.conditional_access": "conditionalAccessStatus"}},
    "okta": {"records": "", "source": "okta", "categories": {"okta:system": "auth"}, "fields": {"id": "uuid", "ts": "published", "severity": "severity", "message": "displayMessage", "src_ip": "client.ipAddress", "sourcetype": "=okta:system", "fields.user": "actor.alternateId", "fields.actor_display": "actor.displayName", "fields.event_type": "eventType", "fields.action": "outcome.result", "fields.outcome_reason": "outcome.reason", "fields.city": "client.geographicalContext.city", "fields.country": "client.geographicalContext.country", "fields.user_agent": "client.userAgent.rawUserAgent", "fields.target": "target[0].displayName"}},
    "sentinelone": {"records": "data", "source": "sentinelone", "categories": {"s1:threat": "malware"}, "fields": {"id": "id", "ts": "threatInfo.createdAt", "severity": "threatInfo.confidenceLevel", "message": "threatInfo.threatName", "host": "agentRealtimeInfo.agentComputerName", "src_ip": "agentRealtimeInfo.agentIp", "sourcetype": "=s1:threat", "fields.classification": "threatInfo.classification", "fields.mitigationStatus": "threatInfo.mitigationStatus", "fields.analystVerdict": "threatInfo.analystVerdict"}},
}
