"""Plain single-machine versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re


def near(docs,size=4,pct=80):
    sets={}
    for i,t in docs:
        w=re.findall(r'[^\x20\x09-\x0D]+',re.sub('[A-Z]',lambda m:m[0].lower(),t or ''))
        sets[i]=frozenset(zip(*(w[j:] for j in range(size)))) if len(w)>=size else (frozenset([tuple(w)]) if w else frozenset())
    df=collections.Counter(x for s in sets.values() for x in s)
    inv=collections.defaultdict(list); par={i:i for i in sets}
    def f(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    for i in sorted(sets):
        s=sets[i]; p=sorted(s,key=lambda x:(df[x],x))[:len(s)-(pct*len(s)+99)//100+1]
        cand={j for x in p for j in inv[x]}
        for j in cand:
            a=len(s&sets[j]); u=len(s)+len(sets[j])-a
            if 100*a>=pct*u:
                x,y=f(i),f(j)
                if x!=y: par[max(x,y)]=min(x,y)
        for x in p: inv[x].append(i)
    return {i:(len(sets[i]),f(i)) for i in sets}


def passages(docs,n=50):
    first={}; raw={i:(t or '').encode() for i,t in docs}
    for i in sorted(raw):
        b=raw[i]
        for k in range(len(b)-n+1): first.setdefault(hash(b[k:k+n]),i)
    out={}
    for i,b in raw.items():
        g=bytearray(len(b)); e=0
        for k in range(len(b)-n+1):
            if first[hash(b[k:k+n])]<i:
                for x in range(max(e,k),k+n): g[x]=1
                e=k+n
        out[i]=(len(b),sum(g),sum(1 for k in range(len(b)) if g[k] and (k==0 or not g[k-1])),hashlib.sha256(bytes(c for c,x in zip(b,g) if not x)).hexdigest())
    return out


def search(docs,k=10,every=100):
    W={i:re.findall(r'[^\x20\x09-\x0D]+',re.sub('[A-Z]',lambda m:m[0].lower(),t or '')) for i,t in docs}
    tf={i:collections.Counter(w) for i,w in W.items()}; df=collections.Counter(x for c in tf.values() for x in c); n=len(W); avg=sum(map(len,W.values()))/max(n,1) or 1
    inv=collections.defaultdict(list)
    for i,c in tf.items():
        for x,f in c.items(): inv[x].append((i,f))
    out={}
    for q in W:
        if q%every: continue
        s=collections.defaultdict(float)
        for x in tf[q]:
            idf=math.log1p((n-df[x]+.5)/(df[x]+.5))
            for i,f in inv[x]: s[i]+=idf*f*2.2/(f+1.2*(.25+.75*len(W[i])/avg))
        out[q]=sorted(((-round(v,9),i) for i,v in s.items()))[:k]
    return out


def edit_distance_within(pattern, text):
    """Least edit distance of the pattern to any substring of the text, by the table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def best_segmentation(word, scores, byte_cost):
    """(score, tokens) of the best segmentation, by trying every last piece."""
    s = "\u2581" + word
    best = [(0.0, 0)]
    for i in range(1, len(s) + 1):
        c = s[i - 1]
        options = [(best[j][0] + scores[s[j:i]], -(best[j][1] + 1)) for j in range(i) if s[j:i] in scores]
        if c not in scores:
            n = len(c.encode())
            options.append((best[i - 1][0] + n * byte_cost, -(best[i - 1][1] + n)))
        x = max(options)
        best.append((x[0], -x[1]))
    return best[-1]


def words(text):
    """Runs of non-space bytes with A-Z in lower case."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
