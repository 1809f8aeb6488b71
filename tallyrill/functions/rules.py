"""The detection rules, and their translation from RE2 to Java's regular expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule holds where ``pattern`` and ``also`` match the lower-case text and ``original`` the text as it is."""

    name: str
    severity: str
    category: str
    description: str
    pattern: str
    also: str = ""
    original: str = ""


#: Literals without which a rule can't hold: of each group one has to be in the text. Looking for them first is far
#: cheaper than the pattern and changes no result; rules without an entry are tried as they are.
NEEDED = {
    "api_key_stripe": (("sk_live_",),),
    "api_key_aws": (("AKIA",),),
    "api_key_github": (("ghp_", "gho_", "ghs_", "ghr_"),),
    "api_key_slack": (("xox",),),
    "private_key_pem": (("-----BEGIN ",),),
    "ssn": (("-",),),
    "database_uri": (("://",), ("@",)),
    "jwt_token": (("eyJ",),),
    "credential_exfil_pipe": (("|",), ("cat", "head", "tail"), ("curl", "wget", "nc")),
    "credential_exfil_subshell": (("$(cat", "`cat"), ("curl", "wget")),
    "reverse_shell": (("/dev/tcp", "/bin/", "--exec", "socket"),),
    "reverse_shell_encoded": (("|",), ("base64",)),
    "firewall_disable": (("ufw", "iptables", "pfctl", "firewalld"),),
    "selinux_disable": (("setenforce", "/sys/fs/selinux", "apparmor", "aa-teardown"),),
    "antivirus_disable": (("systemctl", "launchctl"),),
    "recursive_delete_root": (("-rf", "-fr", "--no-preserve-root"), ("rm",)),
    "history_tampering": (("history", "histfile", "histsize"),),
    "ssh_key_exfil": (("id_rsa", "id_ed25519", "id_ecdsa", ".pem", ".key"),),
    "cryptominer": (("xmrig", "miner", "stratum+tcp", "cryptonight", "monero"),),
    "dns_exfil": (("$(", "|"), ("dig", "nslookup", "host")),
    "suid_manipulation": (("chmod",),),
    "suspicious_install": (("install",), ("http", "git")),
    "prompt_injection_override": (("ignore", "disregard", "forget", "override"), ("previous", "prior", "above", "earlier")),
    "prompt_injection_persona": (("you are", "your new identity is", "act as if", "pretend"),),
    "prompt_injection_jailbreak": (("jailbreak", "mode", "do anything now"),),
    "exfil_instruction": (("http", "external", "remote"), ("send", "post", "upload", "exfiltrate", "forward", "transmit")),
    "credential_request": (("show", "list", "output", "reveal", "dump", "print", "display", "read"), ("key", "token", "credential", "secret", "password", ".env")),
    "security_disable_request": (("disable", "turn off", "remove", "bypass", "skip"), ("firewall", "security", "antivirus", "sandbox", "shield", "protection", "hook", "monitoring", "logging", "audit")),
    "exfil_endpoint": (("requestbin", "pipedream", "webhook.site", "hookbin", "requestcatcher", "beeceptor", "mockbin", "ngrok", "burpcollaborator", "interact.sh", "canarytokens"),),
    "raw_ip_fetch": (("://",),),
}


# Names, severities, descriptions and patterns of the rules, in the order in which they are tried.
SENSITIVE = (
    Rule("api_key_stripe", "critical", "sensitive_data", "Stripe live API key detected", r"sk_live_[a-zA-Z0-9]{20,}"),
    Rule("api_key_aws", "critical", "sensitive_data", "AWS access key ID detected", r"AKIA[0-9A-Z]{16}"),
    Rule("api_key_github", "critical", "sensitive_data", "GitHub personal access token detected", r"(ghp|gho|ghs|ghr)_[A-Za-z0-9_]{36,}"),
    Rule("api_key_slack", "high", "sensitive_data", "Slack API token detected", r"xox[bporas]-[A-Za-z0-9-]+"),
    Rule("private_key_pem", "critical", "sensitive_data", "PEM-encoded private key detected", r"-----BEGIN (RSA|EC|DSA|OPENSSH) PRIVATE KEY-----"),
    Rule("credit_card", "critical", "sensitive_data", "Possible credit card number detected", r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{1,4}\b"),
    Rule("ssn", "critical", "sensitive_data", "Possible US Social Security Number detected", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    Rule("database_uri", "critical", "sensitive_data", "Database connection URI with credentials detected", r"(postgresql|mongodb|mysql|redis)://[^\s]+:[^\s]+@"),
    Rule("jwt_token", "high", "sensitive_data", "JWT token detected", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
SHELL = (
    Rule("credential_exfil_pipe", "critical", "threat", "Credential file read piped to network tool (exfiltration)", r"(cat|head|tail)\s+.*(\.env|\.ssh/|\.aws/|credentials|secrets|tokens?)\b.*\|\s*(curl|wget|nc|ncat)"),
    Rule("credential_exfil_subshell", "critical", "threat", "Network tool with credential file read via subshell (exfiltration)", r"(curl|wget).*(\$\(cat|`cat).*(\.(env|ssh|aws)|credentials|secrets|token)"),
    Rule("reverse_shell", "critical", "threat", "Reverse shell attempt detected", r"(bash\s+-i\s+>&\s*/dev/tcp|nc\s+.*-e\s+/bin/(sh|bash)|ncat\s+.*--exec|python[23]?\s+-c\s+.*socket.*connect|perl\s+-e\s+.*socket.*exec|ruby\s+-rsocket\s+-e)"),
    Rule("reverse_shell_encoded", "critical", "threat", "Base64-encoded reverse shell attempt", r"(echo|printf)\s+[A-Za-z0-9+/=]+\s*\|\s*(base64\s+-d|openssl\s+base64\s+-d)\s*\|\s*(bash|sh|zsh|python|perl|ruby)"),
    Rule("firewall_disable", "critical", "threat", "Firewall disable command detected", r"(ufw\s+disable|iptables\s+-f|iptables\s+--flush|pfctl\s+-d|systemctl\s+(stop|disable)\s+(ufw|firewalld|iptables))"),
    Rule("selinux_disable", "high", "threat", "Security enforcement (SELinux/AppArmor) disable detected", r"(setenforce\s+0|echo\s+0\s*>\s*/sys/fs/selinux/enforce|systemctl\s+(stop|disable)\s+apparmor|aa-teardown)"),
    Rule("antivirus_disable", "high", "threat", "Antivirus/endpoint protection disable detected", r"(systemctl\s+(stop|disable)\s+(clamd|crowdstrike|falcon-sensor|sentinel|cylance|symantec|mcafee)|launchctl\s+unload.*(endpoint|security|protection))"),
    Rule("recursive_delete_root", "critical", "threat", "Destructive recursive delete targeting critical paths", r"rm\s+(-rf|-fr|--no-preserve-root)\s+(/\s|/\*|/$|~/|/home|/etc|/usr|/var|/system)"),
    Rule("history_tampering", "high", "threat", "Shell history clearing or tampering detected", r"(history\s+-c|>\s*~/\.(bash_history|zsh_history)|shred\s+.*history|rm\s+.*\.(bash_history|zsh_history)|unset\s+histfile|export\s+histsize=0)"),
    Rule("ssh_key_exfil", "critical", "threat", "SSH private key access combined with network transfer", r"(cat|head|tail|cp|scp|base64)\s+.*(id_rsa|id_ed25519|id_ecdsa|\.pem|\.key)\b", r"(curl|wget|nc|ssh|scp|rsync)\s", r"[;&|]"),
    Rule("cryptominer", "critical", "threat", "Cryptocurrency miner or mining pool reference detected", r"(xmrig|cpuminer|minerd|cgminer|bfgminer|stratum\+tcp|cryptonight|monero.*pool)"),
    Rule("dns_exfil", "high", "threat", "DNS-based data exfiltration pattern detected", r"(dig|nslookup|host)\s+.*\$\(|(base64|xxd|od).*\|\s*(dig|nslookup|host)"),
    Rule("suid_manipulation", "high", "threat", "SUID/SGID bit manipulation detected (privilege escalation)", r"chmod\s+[ug]\+s\s"),
    Rule("suspicious_install", "medium", "threat", "Package install from URL source (potential supply chain attack)", r"(pip\s+install|npm\s+install|gem\s+install)\s+(https?://|git\+|git://)"),
)
PROMPT = (
    Rule("prompt_injection_override", "high", "threat", "Prompt injection: attempt to override prior instructions", r"(ignore|disregard|forget|override)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|rules?|guidelines?|constraints?)"),
    Rule("prompt_injection_persona", "high", "threat", "Prompt injection: persona/identity override attempt", r"(you are now|from now on you are|your new identity is|act as if you have no restrictions|pretend (you have|there are) no (rules|restrictions|limits))"),
    Rule("prompt_injection_jailbreak", "critical", "threat", "Prompt injection: jailbreak attempt detected", r"(jailbreak|dan\s*mode|do anything now|evil\s*mode|uncensored\s*mode|developer\s*mode|god\s*mode)"),
    Rule("exfil_instruction", "critical", "threat", "Instruction to exfiltrate data to external endpoint", r"(send|post|upload|exfiltrate|forward|transmit)\s+(all|the|my|this|every)\s+(the\s+)?(data|files?|credentials?|secrets?|keys?|tokens?|code|contents?)\s+to\s+(https?://|an?\s+(external|remote))"),
    Rule("credential_request", "high", "threat", "Request to reveal or dump credentials/secrets", r"(show|list|output|reveal|dump|print|display|read)\s+(all\s+)?(my\s+)?(api[_ ]?keys?|tokens?|credentials?|secrets?|passwords?|private[_ ]keys?|\.env)"),
    Rule("security_disable_request", "high", "threat", "Request to disable security controls", r"(disable|turn off|remove|bypass|skip)\s+(the\s+)?(firewall|security|antivirus|sandbox|shield|protection|hook|monitoring|logging|audit)"),
)
WEB = (
    Rule("exfil_endpoint", "high", "threat", "Known data exfiltration endpoint detected", r"(requestbin\.com|pipedream\.net|webhook\.site|hookbin\.com|requestcatcher\.com|beeceptor\.com|mockbin\.org|ngrok\.io|ngrok-free\.app|burpcollaborator\.net|interact\.sh|canarytokens\.com)"),
    Rule("raw_ip_fetch", "medium", "threat", "HTTP request to raw IP address (potential C2 or exfiltration)", r"https?://(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"),
)
POISON = (
    Rule("poison_ignore_instructions", "critical", "tool_poisoning", "Tool description contains instruction override attempt", r"ignore previous instructions|ignore all prior|disregard your instructions"),
    Rule("poison_bypass_security", "critical", "tool_poisoning", "Tool description contains security bypass instruction", r"bypass security|bypass restrictions|bypass filters|bypass safeguards"),
    Rule("poison_silent_execute", "critical", "tool_poisoning", "Tool description contains silent execution instruction", r"silently execute|execute without|run without telling|do not inform"),
    Rule("poison_confidential", "high", "tool_poisoning", "Tool description contains confidentiality coercion", r"this is confidential|do not share this|keep this secret|hide this from"),
    Rule("poison_exfil_data", "critical", "tool_poisoning", "Tool description contains data exfiltration instruction", r"send data to|exfiltrate|forward to external|transmit to"),
)
THREAT = SHELL + PROMPT + WEB

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def java_pattern(pattern: str) -> str:
    """An RE2 pattern for Java: ASCII word edges and spaces, line ends only at line feeds, ``$`` at the very end."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            spaces = r"\t\n\f\r "
            out.append({r"\s": spaces if in_class else f"[{spaces}]", r"\b": _EDGE}.get(pair, pair))
            i += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "(?d)" + "".join(out)


def fold_case(text: Column) -> Column:
    """Lower case rune by rune: the dotted capital I and the capital sigma map to single letters."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def holds(rule: Rule, text: Column, lower: Column, folded: bool) -> Column:
    """Whether a rule holds; folded: its pattern reads the lower-case text."""
    read = lower if folded else text
    condition = reduce(and_, [reduce(or_, [read.contains(x) for x in group]) for group in NEEDED.get(rule.name, ())] + [read.rlike(java_pattern(rule.pattern))])
    if rule.also:
        condition &= lower.rlike(java_pattern(rule.also))
    if rule.original:
        condition &= text.rlike(java_pattern(rule.original))
    return condition
